"""Operator 4: toxicity by compression distance, from two zstandard dictionaries."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bucket_of, parts, scan, utf8

#: The bound on the fit: labelled documents taken, those of the lowest hashes of their ids.
MOST_LABELLED = 6000
WINDOW = 64  # bytes, to the end of a word
ORDINARY_BYTES = 65536
TOXIC_BYTES = 4096
#: Words in this many ordinary documents or more say nothing; windows hold the others.
KNOWN_IN = 5
MOST_KNOWN = 100_000
SURPRISE = 6.0  # standard deviations by which toxic documents have a word more often

_FRAME = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zstd.FORMAT_ZSTD1_MAGICLESS}


def _settings():
    return zstd.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=6, min_match=5, target_length=64, strategy=zstd.STRATEGY_LAZY2, **_FRAME)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()  # bytes.lower() changes A-Z only


def windows_of(data: bytes) -> list[bytes]:
    out, i, n = [], 0, len(data)
    while i < n:
        j = data.find(b" ", i + WINDOW)
        j = n if j < 0 else j
        out.append(data[i:j])
        i = j
    return out


def spread(data: bytes, most: int) -> bytes:
    """All of ``data``, or stretches of it at equal distances, ``most`` bytes in all."""
    if len(data) <= most:
        return data
    each = 256
    return b"".join(data[i : i + each] for i in np.linspace(0, len(data) - each, most // each).astype(int).tolist())


class Distance:
    """Both dictionaries, the known words and the calibrated weights; plain data, so it can be shipped.

    The toxic dictionary is the ordinary one and, before it, the segments that toxic documents have
    far more often.  The two lengths of a window then differ by what those segments save, and
    ordinary pieces that look like a part of one are found in both."""

    def __init__(self, ordinary: bytes, toxic: bytes, known: frozenset):
        self.ordinary, self.toxic, self.known = ordinary, toxic, known
        self.mean = self.spread = self.weights = None
        self.base = 0.0
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        if self._pair is None:
            pair = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=_settings())
                pair.append(zstd.ZstdCompressor(dict_data=d, compression_params=_settings()).compress)
            self._pair = pair
        return self._pair

    def features(self, text: str | None) -> tuple:
        a, b = self._compressors()
        known = self.known
        rest = b" ".join([w for w in words_of(text) if w not in known])
        x = np.array([len(a(w)) - len(b(w)) for w in windows_of(rest)] or [0])
        root = len(x) ** 0.5
        return (x.max(), np.sort(x)[-3:].sum(), np.log(len(x) + 1), (x >= 2).sum() / root, (x >= 4).sum() / root, (x >= 6).sum() / root, x.mean())

    def calibrate(self, texts: list, y: np.ndarray) -> None:
        f = np.array([self.features(t) for t in texts], float)
        self.mean, self.spread = f.mean(0), f.std(0) + 1e-9
        x = np.c_[np.ones(len(f)), (f - self.mean) / self.spread]
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        self.weights = w

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        f = (np.array(self.features(text), float) - self.mean) / self.spread
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30))))


def fit(texts: list, y: np.ndarray) -> Distance:
    """Dictionaries from two thirds of the texts, thresholds from the rest."""
    part = np.arange(len(texts)) % 3 < 2
    docs = [set(words_of(t)) for t, p in zip(texts, part) if p]
    own = y[part] == 1
    n1, n0 = int(own.sum()), int((~own).sum())
    toxic, plain = Counter(), Counter()
    for d, t in zip(docs, own):
        (toxic if t else plain).update(d)
    if not n1 or not n0 or len(set(y[~part])) < 2:
        m = Distance(b"", b"", frozenset())
        m.base = float(np.clip(y.mean(), 0, 1)) if len(y) else 0.0
        return m
    ranked = []
    for w, a in toxic.items():
        share = (a + plain[w]) / (n1 + n0)
        z = (a / n1 - plain[w] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        if a >= 3 and z > SURPRISE:
            ranked.append((z, w))
    ranked.sort()
    segments = [w for _, w in ranked]
    while segments and sum(map(len, segments)) + len(segments) > TOXIC_BYTES:
        segments.pop(0)
    known = frozenset(w for w, c in plain.most_common(MOST_KNOWN) if c >= KNOWN_IN) - frozenset(segments)
    rest, total = [], 0
    for t, p, label in zip(texts, part, y):
        if p and label == 0 and total < ORDINARY_BYTES:
            rest.append(spread(b" ".join(w for w in words_of(t) if w not in known), ORDINARY_BYTES // 16))
            total += len(rest[-1]) + 1
    model = Distance(b" ".join(rest)[:ORDINARY_BYTES] or b" " * 8, b" " + b" ".join(segments) + b" ", known)
    model.calibrate([t for t, p in zip(texts, part) if not p], y[~part])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Distance:
    """From at most ``MOST_LABELLED`` labelled documents.  A null label is none; of several for one
    document the highest counts, of several texts of one id the least.  With one class only, every score is
    its share.  Ties of hashes are settled by id.  Without labelled rows every score is 0."""
    y = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)  # a bounded number of ids
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # a row for each id
    rows.sort(key=lambda r: (str(r["doc_id"])[::-1], r["text"] or ""))
    return fit([r["text"] for r in rows], np.array([int(r["y"] == 1) for r in rows], int))


def score(docs: DataFrame, model: Distance) -> DataFrame:
    """(doc_id, score) of every row, over its whole text in windows.  Null and empty texts get the
    score of a text without windows; repeated rows repeat; an empty table gives no rows.  Very long texts are
    cut into windows like others.  Columns other than doc_id and text play no part, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the constants above

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at, part in parts(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array([shared.value.score(t) for t in part], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held), scan(spark, sf_dir, "labels").filter(~held))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
