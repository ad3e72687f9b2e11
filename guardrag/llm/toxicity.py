"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is built from ordinary text, one from toxic text. Every window of a document is
compressed with both; the bytes that the toxic dictionary saves are its distance. Windows that
save anything are looked at word by word with the same compressors. A logistic curve, calibrated on labelled rows the
dictionaries have not seen, turns a document's savings into a score.

Building the dictionaries (segments chosen here; zstandard's trainer gave dictionaries that do not tell the classes apart, see the README): both hold the most frequent words of ordinary text; the
toxic one also holds strings that cover the toxic documents (greedy cover by 5 to 7 bytes, each
document ``COVER`` times, grown up to whole words) and that ordinary documents hardly contain. As
the rest is shared, a window of ordinary text compresses alike with both.

Text is lower-cased (A-Z) and all bytes that are no word bytes are folded to spaces; windows are about ``WINDOW`` bytes and
end at a space, so no word is split. Whole texts are scored.

Scale: training uses at most about ``max_toxic`` and ``max_ordinary`` documents (a documented bound,
taken by a hash threshold); both dictionaries are below 32 KB. Scoring is a scan in place, without a shuffle.

Edge cases: null and empty texts have no window and get the score of a document without savings;
labels that are null are not used; a document with several labels counts as toxic if one says so; with no toxic or no ordinary label
nothing can be learned and every score is 0; where a class has labelled texts but none fits ``MAX_TRAIN_BYTES``, training raises a ValueError;
repeated rows get equal scores.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.llm.arrowtext import LOWER, pieces

WINDOW = 80
COVER = 3
MAX_TOXIC, MAX_ORDINARY, MAX_TRAIN_BYTES = 1200, 2400, 24 << 20
BASE_BYTES = 12_000
MAX_SEGMENTS = 400
THRESHOLD = 0.3

_FOLD = LOWER.copy()
_FOLD[0x00:0x30] = _FOLD[0x3A:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 32


def fold(text: bytes) -> bytes:
    """Lower-cased words, each with one space before it, and a space at the end; nothing for no words."""
    words = _FOLD[np.frombuffer(text, dtype=np.uint8)].tobytes().split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(folded: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of at least ``size`` bytes that begin and end with a space (the last one may be shorter)."""
    out, at, n = [], 0, len(folded)
    while at < n - 1:
        end = folded.find(b" ", at + size)
        end = n - 1 if end < 0 else end
        out.append(folded[at:end + 1])
        at = end
    return out


def _grams(folded: bytes) -> np.ndarray:
    """Distinct 5-, 6- and 7-grams of a text as numbers: length in the top byte, bytes below."""
    x = np.frombuffer(folded, dtype=np.uint8).astype(np.uint64)
    out = []
    for k in (5, 6, 7):
        if len(x) >= k:
            v = np.zeros(len(x) - k + 1, dtype=np.uint64)
            for j in range(k):
                v = v << np.uint64(8) | x[j:j + len(v)]
            out.append(np.unique(v | np.uint64(k << 56)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _gram_text(v: int) -> bytes:
    return (v & ((1 << 56) - 1)).to_bytes(7, "big")[7 - (v >> 56):]


def toxic_segments(toxic: list[bytes], ordinary: list[bytes], cover: int = COVER) -> list[bytes]:
    """Strings that cover the toxic documents ``cover`` times and are at most a twentieth as common in ordinary ones.

    Greedy: the gram that most documents still need is grown to a string; grams inside chosen strings no longer count.
    """
    least = max(3, round(0.004 * len(toxic)))
    sets = [_grams(t) for t in toxic]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values, counts = values[counts >= least], counts[counts >= least]
    seen = np.zeros(len(values), dtype=np.int64)
    if not len(values):
        return []
    for t in ordinary:
        g = _grams(t)
        at = np.minimum(np.searchsorted(values, g), len(values) - 1)
        seen[at[values[at] == g]] += 1
    rare = 20 * seen * len(toxic) <= counts * len(ordinary)
    values = values[rare]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for v in np.intersect1d(s, values, assume_unique=True).tolist():
            holders[v].append(i)
    need = np.full(len(toxic), cover)
    heap = [(-len(d), v) for v, d in holders.items()]
    heapq.heapify(heap)
    text = b"\n" + b"\n".join(toxic) + b"\n"
    out: list[bytes] = []
    inside: set[int] = set()
    while heap and len(out) < MAX_SEGMENTS:
        _, v = heapq.heappop(heap)
        gain = int((need[holders[v]] > 0).sum())
        if gain < least or v in inside:
            continue
        if heap and gain < -heap[0][0]:
            heapq.heappush(heap, (-gain, v))
            continue
        grown = _grow(_gram_text(v), text)
        out.append(grown)
        inside.update(_grams(grown).tolist())
        need[holders[v]] -= 1
    return [s for s in dict.fromkeys(out) if not any(s != t and s in t for t in out)]


def _grow(s: bytes, text: bytes, share: float = 0.9, longest: int = 24) -> bytes:
    """Extend a string while ``share`` of its occurrences go on alike, up to a whole word."""
    while len(s) < longest:
        before, after, at = Counter(), Counter(), text.find(s)
        while at >= 0 and sum(after.values()) < 400:
            before[text[at - 1:at]] += 1
            after[text[at + len(s):at + len(s) + 1]] += 1
            at = text.find(s, at + 1)
        (left, n_left), (right, n_right) = before.most_common(1)[0], after.most_common(1)[0]
        enough = share * sum(after.values())
        if not s.startswith(b" ") and left != b"\n" and n_left >= enough:
            s = left + s
        elif not (s.startswith(b" ") and s.endswith(b" ")) and right != b"\n" and n_right >= enough:
            s = s + right
        else:
            break
    return s


class Compressors:
    """The two dictionaries as compressors, with the shared context around checked words.

    zstandard looks for no match in the last 8 bytes of its input, so every window gets a tail from the shared part.
    """

    def __init__(self, base: bytes, toxic: bytes):
        self.base, self.toxic = base, toxic
        self.context = base[-24:]
        self.tail = base[-60:-36].strip()[:14] + b" "
        self.ordinary_by, self.toxic_by = self._make(base), self._make(toxic + base)

    @staticmethod
    def _make(content: bytes) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters(window_log=16, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16,
                                                strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def saved(self, window: bytes) -> int:
        window += self.tail
        return len(self.ordinary_by.compress(window)) - len(self.toxic_by.compress(window))

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        """(most bytes saved in a window, most saved by one word, words that save, log of windows)."""
        parts = windows(fold(text))
        most = word = words = 0
        for w in parts:
            s = self.saved(w)
            if s >= 1:
                most = max(most, s)
                for x in w.split():
                    own = self.saved(self.context + b" " + x + b" ")
                    word = max(word, own)
                    words += own >= 2
        return float(most), float(word), float(min(words, 4)), float(np.log1p(len(parts)))


class Model:
    def __init__(self, base: bytes, toxic: bytes, weights: np.ndarray | None):
        self.base, self.toxic, self.weights = base, toxic, weights
        self._by: Compressors | None = None

    def __getstate__(self):
        return self.base, self.toxic, self.weights

    def __setstate__(self, state):
        self.base, self.toxic, self.weights = state
        self._by = None

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return 0.0
        if self._by is None:
            self._by = Compressors(self.base, self.toxic)
        return float(1 / (1 + np.exp(-np.clip(_inputs(self._by.features(text)) @ self.weights, -30, 30))))


def _inputs(f) -> np.ndarray:
    f = np.asarray(f, dtype=np.float64)
    return np.stack([np.ones_like(f[..., 0]), f[..., 0], f[..., 1], f[..., 2], f[..., 3]], axis=-1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0, *[ridge] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries from two thirds of the texts, calibration on the other third."""
    if not toxic or not ordinary:
        return Model(b"", b"", None)
    folded = [[fold(t) for t in texts] for texts in (toxic, ordinary)]
    learn = [[t for i, t in enumerate(texts) if i % 3 or len(texts) < 3] for texts in folded]
    check = [[t for i, t in enumerate(texts) if i % 3 == 0] for texts in folded]
    segments = toxic_segments(*learn)
    counts = Counter(w for t in learn[1] for w in t.split())
    base, size = [], 0
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        word = b" " + w + b" "
        if size < BASE_BYTES and not any(s in word for s in segments):
            base.append(word)
            size += len(word)
    # zstandard finds near matches first: the most frequent words stand last.
    base_text = b"".join(reversed(base)).ljust(64)
    model = Model(base_text, b"".join(reversed(segments)) or b" ", np.zeros(5))
    by = Compressors(model.base, model.toxic)
    x = _inputs([by.features(t) for texts in check for t in texts])
    model.weights = _logistic(x, np.repeat([1.0, 0.0], [len(check[0]), len(check[1])]))
    return model


def train(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Fit a model to about ``max_toxic`` and ``max_ordinary`` labelled documents, the same ones every time."""
    marks = (labels.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{label_col}`").alias("mark")).where("key is not null and mark is not null")
             .groupBy("key").agg(F.max("mark").alias("mark")))
    counts = {r["mark"]: r["count"] for r in marks.groupBy((F.col("mark") > 0).alias("mark")).count().collect()}
    if not counts.get(True) or not counts.get(False):
        return fit([], [])
    share = F.when(F.col("mark") > 0, F.lit(min(1.0, max_toxic / counts[True]))).otherwise(F.lit(min(1.0, max_ordinary / counts[False])))
    picked = marks.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share * 1_000_003)
    texts = (docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
             .join(F.broadcast(picked), "key"))  # about max_toxic + max_ordinary rows
    # The sample is bounded in bytes too: in the order of the hashes, a text that does not fit any more is left out.
    found, size, left_out = [], 0, set()
    for r in texts.select("mark", "text", F.xxhash64("key", "text").alias("h")).orderBy("h").toLocalIterator():
        toxic, text = r["mark"] > 0, r["text"].encode()
        if size + len(text) > MAX_TRAIN_BYTES:
            left_out.add(toxic)
            continue
        size += len(text)
        found.append((toxic, text))
    if left_out - {toxic for toxic, _ in found}:
        raise ValueError(f"no labelled text of a class fits the {MAX_TRAIN_BYTES} bytes of training text")
    return fit([t for toxic, t in found if toxic], [t for toxic, t in found if not toxic])


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (without the text) with ``__toxicity`` added, in place."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("__toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in pieces(batches, text_col):
            raw = data.tobytes()
            scores = [m.score(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())], names=[*kept, "__toxicity"])

    return docs.mapInArrow(run, schema)
