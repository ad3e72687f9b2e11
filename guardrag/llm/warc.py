"""WARC archives and their capture index.

``write_archives`` turns pages into WARC/1.1 records (gzip files that Spark's text writer stores: one record
per row, rows ended by two line breaks; ``offset`` counts uncompressed bytes). Each file is one locally sorted
capture run, ordered by (URL key, timestamp, page). Of records with equal payloads of at least
``min_revisit`` bytes the one with the largest page id is a response; the others are revisits
that refer to it and carry no payload.

``read_archives`` parses whole files by Content-Length (never by separators, which a payload may hold) into
one index row per record. ``merge_index`` merges the sorted runs: the key space is cut into ranges,
each range task receives the slices of all runs and merges them k-way with a loser tree, which
gives globally ordered capture histories.

Scale: the payload is shuffled once, by page id, into files of about ``file_bytes``; which pages are revisits is found
on ids and digests alone (a partially aggregated maximum per digest, joined back on the digest,
which AQE can split when one digest fills a third of the table). The index rows are narrow; a hot URL is split
between ranges since timestamp and page are part of the key.

Edge cases: null html is an empty payload; a null URL is written as an empty target and sorts first; null page
ids are written as "null" and read back as null; repeated rows give repeated records, one
response among equal (digest, page) rows and revisits that refer to the same page id otherwise;
a table without rows gives no files and an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.session import materialize, scratch_path

MIN_REVISIT = 1000
#: The first capture date; a page's date is this plus its id in seconds, as pages carry no time of their own.
EPOCH = 1_577_836_800
DATES = 250_000_000_000
END = "\r\n\r\n"
FILE_BYTES = 8 << 20

INDEX = ("run string, url_key string, captured string, page_id long, offset long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, url string")


def url_key(url: Column) -> Column:
    """Host labels reversed, then the rest, lower-cased: ``com,example,www)/path``."""
    url = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as WARC files, one sorted capture run each, under ``path``."""
    page = F.col(f"`{id_col}`").cast("long")
    rows = pages.select(page.alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    # Line breaks would end a header early; they cannot be part of a URL.
    rows = rows.withColumns({"url": F.regexp_replace("url", r"[\r\n]+", " "), "key": F.regexp_replace(url_key(F.col("url")), r"[\r\n]+", " ")})
    rows = rows.withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    total = rows.agg(F.sum(F.col("size") + 600)).first()[0] or 0
    # Which pages are revisits is found on ids and digests alone; the payload is shuffled once, by page.
    long_ones = rows.where(F.col("size") >= min_revisit).select("name", "page_id", "digest")
    first = (long_ones.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
             .where((F.col("copies") > 1) & F.col("first").isNotNull()).drop("copies"))
    revisits = long_ones.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("name", "digest", "first").distinct()
    files = max(1, math.ceil(total / file_bytes))
    rows = rows.repartition(files, "name", "digest").join(revisits, ["name", "digest"], "left")
    revisit = F.col("first").isNotNull()
    name = F.col("name")
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    # Dates stay between the years 2020 and 9941, whatever the ids.
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(DATES))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", kind), _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", date), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                                 _header("X-Payload-Length", F.col("size").cast("string")))).otherwise(F.lit("")),
        _header("X-Url-Key", F.col("key")), _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    runs = rows.select("key", date.alias("date"), "page_id", record.alias("value")).sortWithinPartitions("key", "date", "page_id")
    runs.select("value").write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_archive(content: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, payload) of every record of an archive file."""
    at, size = 0, len(content)
    while at < size:
        blank = content.index(b"\r\n\r\n", at)
        lines = content[at:blank].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(b": ", 1) for line in lines[1:])
        start = blank + 4
        end = start + int(headers[b"Content-Length"])
        yield at, headers, content[start:end]
        at = end + 4


def _page(value: bytes | None) -> int | None:
    number = value[len("<urn:page:"):-1] if value else b"null"
    return None if number == b"null" else int(number)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record under ``path``; files are read and parsed whole, in place."""
    schema = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, h, payload in parse_archive(gzip.decompress(content.as_py())):
                    revisit = h[b"WARC-Type"] == b"revisit"
                    digest = h[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest differs from its header in {run} at byte {offset}")
                    rows.append((run, h[b"X-Url-Key"].decode(), h[b"WARC-Date"].decode(), _page(h[b"WARC-Record-ID"]), offset,
                                 int(h[b"X-Payload-Length"]) if revisit else len(payload), digest, h[b"WARC-Type"].decode(),
                                 _page(h[b"WARC-Refers-To"]) if revisit else None, h[b"WARC-Target-URI"].decode()))
                columns = list(zip(*rows)) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, INDEX)


class LoserTree:
    """k-way merge of sorted runs: each inner node holds the loser of its match, the root the overall winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * self.k
        for r in range(self.k):
            self._replay(r, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Run a's next row comes before run b's; an exhausted run loses, ties go to the lower run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _replay(self, run: int, building: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0 and building:
                self.tree[node] = run
                return
            if self._beats(held, run):
                self.tree[node], run = run, held
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, row number) in merged order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.tree[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._replay(run)


def merge_index(index: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """The index rows in capture-history order: ``merge_range`` and ``merge_pos`` give the global order."""
    index = materialize(index, "runs")
    n = max(1, -(-index.count() // range_rows))
    key_first = "run, url_key, captured, page_id"
    schema = INDEX + ", merge_range int, merge_pos long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        names, urls, dates, pages = (table.column(c.strip()).to_pylist() for c in key_first.split(","))
        rows = [((url, date, page is not None, page or 0), i) for i, (url, date, page) in enumerate(zip(urls, dates, pages))]
        # The slice of a run arrives in its order; where blocks of it come out of order, each ascending stretch is a run of its own.
        ordered: list[list] = []
        open_: dict[str, list] = {}
        for name, row in zip(names, rows):
            if name not in open_ or row[0] < open_[name][-1][0]:
                open_[name] = []
                ordered.append(open_[name])
            open_[name].append(row)
        # Equal rows of different runs follow the order of the runs' names.
        ordered.sort(key=lambda run: (names[run[0][1]], run[0][1]))
        take = [ordered[r][i][1] for r, i in LoserTree(ordered)]
        out = table.take(pa.array(take, pa.int64())).combine_chunks()
        place = table.column("merge_range")[0].as_py()
        out = out.drop_columns(["merge_range"]).append_column("merge_range", pa.array([place] * len(out), pa.int32()))
        yield from out.append_column("merge_pos", pa.array(range(len(out)), pa.int64())).to_batches()

    ranged = index.repartitionByRange(n, "url_key", "captured", "page_id").withColumn("merge_range", F.spark_partition_id())
    return ranged.mapInArrow(merge, schema)


def capture_positions(merged: DataFrame) -> DataFrame:
    """``merged`` with ``capture_pos``: each record's place (from 0) in the one capture history of all ranges."""
    merged = materialize(merged, "merged")
    starts, at = [], 0
    for r in merged.groupBy("merge_range").count().orderBy("merge_range").collect():  # a row per range
        starts.append((r["merge_range"], at))
        at += r["count"]
    if not starts:
        return merged.withColumn("capture_pos", F.lit(None).cast("long"))
    frame = merged.sparkSession.createDataFrame(starts, "merge_range int, start long")
    return merged.join(F.broadcast(frame), "merge_range").withColumn("capture_pos", F.col("start") + F.col("merge_pos")).drop("start")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared scratch folder, read them back, merge their index."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return capture_positions(merge_index(read_archives(pages.sparkSession, path)))
