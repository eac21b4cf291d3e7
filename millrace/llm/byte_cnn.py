"""Operator 10: language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bucket_of, parts, scan, utf8, written

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bound on the fit: documents per language, windows per document.
TRAIN_DOCS = 400
TRAIN_WINDOWS = 6
EPOCHS = 12
BROADCAST_LANGUAGES = 10_000
CHUNK = 1024  # windows worked on at once
LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: bytes) -> np.ndarray:
    """All of ``data`` in windows of fixed length, the last one padded with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class ByteCNN:
    """One-hot bytes -> filters of several widths -> max over places -> ReLU -> softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.w = [r.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)
        self.pairs = None

    def _conv(self, x: np.ndarray, i: int) -> np.ndarray:
        k, w = WIDTHS[i], self.w[i]
        n = x.shape[1] - k + 1
        if self.pairs is None:
            out = w[0][x[:, :n]]
            for j in range(1, k):
                out += w[j][x[:, j : j + n]]
            return out
        # two bytes at a time: the sum of two rows looked up in one table
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = np.take(self.pairs[i][0], two[:, :n], axis=0)
        for j in range(2, k, 2):
            out += np.take(self.pairs[i][j // 2], two[:, j : j + n], axis=0) if j + 1 < k else np.take(w[j], x[:, j : j + n], axis=0)
        return out

    def frozen(self) -> ByteCNN:
        self.pairs = [[(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)] for k, w in zip(WIDTHS, self.w)]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([np.maximum(self._conv(x, i).max(1) + self.b[i], 0) for i in range(len(WIDTHS))], 1)
        return h @ self.v + self.c

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        r, step = np.random.default_rng(seed), 0
        weight = (len(y) / (len(self.classes) * np.maximum(1, np.bincount(y, minlength=len(self.classes))))).astype(np.float32)
        params = [*self.w, *self.b, self.v, self.c]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), 128):
                own = order[at : at + 128]
                xb, yb = x[own], y[own]
                pools, tops = [], []
                for i in range(len(WIDTHS)):
                    z = self._conv(xb, i)
                    top = z.argmax(1)
                    pools.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0] + self.b[i])
                    tops.append(top)
                h = np.maximum(np.concatenate(pools, 1), 0)
                s = h @ self.v + self.c
                s = np.exp(s - s.max(1, keepdims=True))
                g = s / s.sum(1, keepdims=True)
                g[np.arange(len(yb)), yb] -= 1
                g *= weight[yb][:, None] / len(yb)
                dh = (g @ self.v.T) * (h > 0)
                grads_w, grads_b = [], []
                for i, k in enumerate(WIDTHS):
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    gw = np.zeros_like(self.w[i])
                    f = np.broadcast_to(np.arange(FILTERS), d.shape)
                    for j in range(k):
                        np.add.at(gw[j], (np.take_along_axis(xb, tops[i] + j, 1), f), d)
                    grads_w.append(gw)
                    grads_b.append(d.sum(0))
                step += 1
                for p, q, a, b in zip(params, [*grads_w, *grads_b, h.T @ g, g.sum(0)], m1, m2):
                    a += 0.1 * (q - a)
                    b += 0.001 * (q * q - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Of each text the language and its probability, from the mean of its windows' logits."""
        mats = [windows_of(utf8(t)) for t in texts]
        counts = np.array([len(m) for m in mats], np.int64)
        x = np.concatenate(mats)
        z = np.concatenate([self.logits(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)])
        z = np.add.reduceat(z, np.r_[0, np.cumsum(counts)[:-1]], axis=0) / counts[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lettered = [t is not None and LETTER.search(t) is not None for t in texts]
        return [self.classes[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, p.max(1), 0.0).astype(float)


def sample(docs: DataFrame, most: int = TRAIN_DOCS):
    """At most ``most`` texts a language, by hash of id and text (ties are equal rows).

    Languages are counted first, combined within tasks; a document is a candidate with probability
    2 * most / count, so only about twice what is taken is moved, however large the input is."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(labelled.groupBy("lang").agg(F.count("*").alias("many")), "cnn-languages")
    few = counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    rows = labelled.select("lang", "text", h.alias("h")).join(F.broadcast(counts) if few else counts, "lang")
    rows = rows.filter(F.col("h").bitwiseAND(F.lit(2**31 - 1)).cast("double") * F.col("many") < F.lit(2.0 * most * 2**31))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).select("lang", "text", "n")


def train(docs: DataFrame) -> ByteCNN | None:
    """Learns from ``text`` and non-null ``lang`` of the given rows; None if none has a letter.

    Only the drawn windows come to the driver: languages * TRAIN_DOCS * TRAIN_WINDOWS * WINDOW bytes at most."""

    def run(batches):
        for b in batches:
            out = []
            for lang, text, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if LETTER.search(text):
                    w = windows_of(utf8(text))
                    out.append((lang, n, w[np.random.default_rng(n).permutation(len(w))[:TRAIN_WINDOWS]].tobytes()))
            kinds = (pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 3, kinds)], ["lang", "n", "drawn"])

    rows = sorted(sample(docs).mapInArrow(run, "lang string, n int, drawn binary").collect())
    if not rows:
        return None
    names = sorted({r["lang"] for r in rows})
    x = [np.frombuffer(r["drawn"], np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.repeat([names.index(r["lang"]) for r in rows], [len(w) for w in x])
    return ByteCNN(names).fit(np.concatenate(x), y)


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.  Whole texts, in windows of fixed length.

    A null text or one without a letter is ``und`` with score 0, as is everything if nothing was
    learned.  Rows are independent: repeated rows and ids give repeated results, an empty table none.  Very long
    texts are cut into windows like others; of tied languages the first by name.  Columns other than doc_id and
    text play no part, whatever their names."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: filters x 256 x widths
    ready: dict = {}

    def run(batches):
        net = ready.get("net") or ready.setdefault("net", shared.value.frozen())
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at, part in parts(texts):
                langs, scores = net.predict(part)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held).select("doc_id", "text", "lang"))
    return identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
