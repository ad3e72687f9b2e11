"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.llm import (centroid_cluster, decontaminate, fingerprint, importance, jaccard_join, language_id, packing, pivot_index, sharding, suffix_dedup,
                          toxicity, url_filter, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.bucket_of(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"),
                        F.sha2("__kept", 256).alias("kept_sha256"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("run", "offset", "merge_range", "merge_pos")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(urls, url_filter.rules_frame(spark, url_filter.SITE_RULES)).drop("url")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate
    found = d.match_items(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col(d.N_WORDS).alias("n_words"), F.col(d.N_HIT).alias("n_hit"), F.size(d.ITEMS).cast("long").alias("n_items"),
                        d.digest_of_items().alias("items_sha256"), d.contaminated().alias("contaminated"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.bucket_of(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("__toxicity").alias("score"),
                        (F.col("__toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The public byte-level BPE file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_cluster.clusters_with_inertia(_table(spark, sf_dir, "embeddings"))


def _cluster_sql() -> str:
    """Four assignments and three updates as a chain of common table expressions."""
    c = centroid_cluster
    steps = [f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({c.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {c.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.DIMS}),
comp AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
c0 AS (
    SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i
    FROM (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {c.CLUSTERS})"""]
    for n in range(c.ROUNDS + 1):
        steps.append(f"""
a{n} AS (
    SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d
    FROM (SELECT comp.r, c{n}.k, sum((comp.x - c{n}.x) * (comp.x - c{n}.x))::BIGINT AS d FROM comp JOIN c{n} USING (i) GROUP BY ALL) GROUP BY r)""")
        if n < c.ROUNDS:
            steps.append(f"""
c{n + 1} AS (
    SELECT c{n}.k, c{n}.i, coalesce(m.x, c{n}.x) AS x
    FROM c{n} LEFT JOIN (SELECT k, i, floor(sum(x) / count(*))::BIGINT AS x FROM comp JOIN a{n} USING (r) GROUP BY k, i) m ON m.k = c{n}.k AND m.i = c{n}.i)""")
    return ",".join(steps) + f"""
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{c.ROUNDS} JOIN kept USING (r) JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{c.ROUNDS} GROUP BY k) USING (k)"""


QUERIES = {f.__name__: f for f in (op1_language_id, op2_extendible_sharding, op3_suffix_dedup, op4_warc_archive, op5_url_filter, op6_decontaminate,
                                   op7_jaccard_join, op8_fingerprints, op9_toxicity, op10_packing, op11_importance_resampling, op12_embedding_dedup,
                                   op13_centroid_clustering)}

ORACLES = {
    "op2_extendible_sharding": f"""
WITH sized AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS bits FROM documents),
paths AS (
    SELECT s.*, d.depth, s.bits >> (60 - d.depth) AS prefix FROM sized s, (SELECT unnest(range(0, 61))::INT AS depth) d),
sums AS (
    SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS n FROM paths WINDOW w AS (PARTITION BY depth, prefix)),
best AS (
    SELECT r, doc_id, n_bytes, min(depth) AS depth, arg_min(prefix, depth) AS prefix FROM sums
    WHERE b <= {sharding.SHARD_LIMIT} OR n = 1 GROUP BY r, doc_id, n_bytes)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, depth, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth, '0') END AS shard_id,
       n_bytes > {sharding.SHARD_LIMIT} AS oversize
FROM best""",
    "op3_suffix_dedup": """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
    SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s
    FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
m AS (
    SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
e AS (
    SELECT r, p, p > coalesce(lag(p) OVER o + 50, -1) AS opens FROM m WINDOW o AS (PARTITION BY r ORDER BY p)),
spans AS (
    SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(opens::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM e) GROUP BY r, k),
gaps AS (
    SELECT s.r, s.a, coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.a), 0) AS begin_at, s.b FROM spans s),
rest AS (
    SELECT g.r, sum(g.b - g.a) AS n_removed, count(*) AS n_spans,
           string_agg(substr(d.h, 2 * begin_at + 1, 2 * (g.a - begin_at)), '' ORDER BY g.a) || substr(any_value(d.h), 2 * max(g.b) + 1) AS kept
    FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN rest USING (r)""",
    "op4_warc_archive": f"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
    SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest),
parts AS (
    SELECT p.*, f.first, regexp_replace(lower(url), '^.*?://', '', 's') AS rest FROM p
    LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {warc.MIN_REVISIT})
SELECT page_id, url, url_key, captured, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS capture_pos
FROM (SELECT *, array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?#]*'), '.')), ',') || ')'
          || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS url_key,
          strftime(to_timestamp({warc.EPOCH} + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured FROM parts)""",
    "op5_url_filter": """
WITH u AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(action, h, p) AS (VALUES """ + ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.SITE_RULES) + """),
fits AS (
    SELECT page_id, host, path, h || p AS rule, action FROM u, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (
    SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM fits GROUP BY ALL)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM u LEFT JOIN best b ON u.page_id IS NOT DISTINCT FROM b.page_id AND u.host = b.host AND u.path = b.path""",
    "op6_decontaminate": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, list_aggregate(w[s:s + least(len(w), 13) - 1], 'string_agg', ' ') AS words
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)),
spots AS (
    SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE len(w) > 0),
hits AS (
    SELECT sp.doc_id, sp.s, sz.size, wi.item_id
    FROM spots sp CROSS JOIN (SELECT DISTINCT size FROM windows) sz
    JOIN windows wi ON wi.size = sz.size AND wi.words = list_aggregate(sp.w[sp.s:sp.s + sz.size - 1], 'string_agg', ' ')
    WHERE sp.s + sz.size - 1 <= len(sp.w)),
covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS pos FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
    SELECT DISTINCT doc_id, hash(list_aggregate(w[s:s + 4], 'string_agg', ' ')) AS h
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)""",
    "op11_importance_resampling": rf"""
WITH RECURSIVE lut(k, v, n) AS (
    SELECT k::BIGINT, k::BIGINT, 0 FROM range(256) t(k)
    UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM lut WHERE n < 8),
t AS (SELECT k, v FROM lut WHERE n = 8),
texts AS (
    SELECT 0 AS src, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
d AS (
    SELECT src, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
    SELECT src, r, f, count(*) AS n FROM (
        SELECT src, r, w[s] AS f FROM (SELECT src, r, w, unnest(generate_series(1, len(w))) AS s FROM d)
        UNION ALL SELECT src, r, w[s] || ' ' || w[s + 1] FROM (SELECT src, r, w, unnest(generate_series(1, len(w) - 1)) AS s FROM d)
        UNION ALL SELECT src, r, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] FROM (SELECT src, r, w, unnest(generate_series(1, len(w) - 2)) AS s FROM d))
    GROUP BY ALL),
names AS (SELECT row_number() OVER () AS id, f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams)),
crc(id, h, c) AS (
    SELECT id, h, 4294967295::BIGINT FROM names
    UNION ALL SELECT id, substr(h, 3), xor(c >> 8, t.v) FROM crc JOIN t ON t.k = xor(c, ('0x' || substr(h, 1, 2))::BIGINT) & 255 WHERE h <> ''),
hashed AS (SELECT f, xor(c, 4294967295) % {importance.BUCKETS} AS b FROM crc JOIN names USING (id) WHERE crc.h = ''),
tallies AS (SELECT b, coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE AS t FROM grams JOIN hashed USING (f) GROUP BY b),
gains AS (
    SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + {importance.BUCKETS}) / ((s + 1) * (sum(t) OVER () + {importance.BUCKETS}))))::BIGINT AS gain FROM tallies),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM grams JOIN hashed USING (f) JOIN gains USING (b) WHERE src = 0 GROUP BY r),
scores AS (
    SELECT doc_id, len(w) >= {importance.MIN_WORDS} AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r) WHERE src = 0),
places AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM places""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
           AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN label END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS (
    SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS r, min(vec_id) AS m FROM reach JOIN v ON v.r = b GROUP BY a),
degrees AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id,
       vec_id IS NOT DISTINCT FROM coalesce(least(m, vec_id), vec_id) AS kept
FROM v LEFT JOIN least USING (r) LEFT JOIN degrees USING (r)""",
    "op13_centroid_clustering": _cluster_sql(),
}
