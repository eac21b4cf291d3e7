"""Which windows of W tokens occur again elsewhere: exact, over all windows of all texts.

Rows are ranges of consecutive windows of one text, not single windows.  The windows of a text are
cut into ranges by content: a window belongs to the range of its anchor, the place of the least
hash of K tokens inside it.  Equal windows have their anchor at the same distance, so their ranges
have an equal *core*, the tokens that all windows at such distances have in common: at first the
anchor's K tokens.  Ranges whose *whole*, the tokens of all their windows, is equal have all windows
in common.  A pass groups the ranges by core:

- a core that occurs once holds no repeated window; its range is dropped,
- where a core has one whole only, its bytes are equal and all windows of all its ranges repeat; they are settled,
- other ranges are split at fixed distances from the anchor and go through the next pass, with
  longer cores, grouped within their former core.

The last pass works on single windows and groups them by the digests.  That is a
most-significant-digit radix partition of the windows that stops at depth W: a pass's digit is the
core, classes of one are left alone, and the classes at the end are the groups of equal windows.

A core is a 64-bit hash and only sorts ranges into classes; a whole is a 128-bit BLAKE2 digest of the
ranges' own bytes.  Whatever hashes of cores collide, then, a class with more than one whole is split
until single windows are compared by digests of their bytes.
All groups are aggregated before a shuffle and by sums, minima and maxima only; nothing collects a
group, and a join back to a hot group is split by the adaptive skew join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Prefix, mix64, parts, written

SEGMENT = 1 << 19  # windows worked on at once: bounds the memory that a very long text takes
#: Spans that take up to so many bytes are broadcast to the texts; more are shuffled.
BROADCAST_BYTES = 128 << 20

ROWS = "doc long, t long, start int, n int, off int, core long, w1 long, w2 long"


class Tokens:
    """A text as ``v``, a uint64 array of its tokens, and ``data``, its bytes; token i is
    data[starts[i]:ends[i]], or byte i if these are None."""

    def __init__(self, v: np.ndarray, data: bytes, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.v, self.data, self.starts, self.ends = v, data, starts, ends

    def digests(self, a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of tokens a..b-1, with the anchor's distance: an array of two int64 each."""
        if self.starts is not None:
            a, b = self.starts[a], self.ends[b - 1]
        view, of = memoryview(self.data), hashlib.blake2b
        got = [of(view[i:j], digest_size=16, salt=k).digest() for i, j, k in zip(a.tolist(), b.tolist(), _salts(off))]
        return np.frombuffer(b"".join(got), np.int64).reshape(-1, 2)


def _salts(off: np.ndarray) -> list[bytes]:
    raw = off.astype(np.int64).tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def anchored(x: Tokens, width: int, k: int):
    """Ranges of windows by anchor: arrays start, n, off (the anchor's distance from start), core,
    digests of the wholes.  Fewer than ``width`` tokens: none."""
    v, out = x.v, []
    for at in range(0, len(v) - width + 1, SEGMENT):
        part = v[at : at + SEGMENT + width - 1]
        p = Prefix(part)
        h = mix64((p.sums[k:] - p.sums[:-k]) * p.down[: len(part) - k + 1])
        least = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the leftmost at a tie
        span, m = 1, width - k + 1
        while span * 2 <= m:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < m:
            least = np.minimum(least[: len(least) - (m - span)], least[m - span :])
        anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        off = anchor[first] - first
        out.append((first + at, last - first + 1, off, h[anchor[first]], x.digests(first + at, last + at + width, off)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.reshape(0, 2)
    return tuple(np.concatenate(x) for x in zip(*out))


def split(x: Tokens, width: int, step: int, start: int, n: int, off: int, core: int):
    """The range in ranges of at most ``step`` windows whose distances from the anchor are alike by
    ``// step``; their cores within the given core."""
    p = Prefix(x.v[start : start + n - 1 + width])
    block = (off - np.arange(n)) // step
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    block = block[first]
    own = p.runs(off - block * step, off - (block + 1) * step + 1 + width)
    parent = np.uint64(core & 0xFFFFFFFFFFFFFFFF)
    return first + start, last - first + 1, off - first, mix64(own ^ parent), x.digests(first + start, last + start + width, off - first)


def _batch(bits, doc, t, start, n, off, core, whole):
    core = core >> np.uint64(64 - bits)
    small = [pa.array(x.astype(np.int32)) for x in (start, n, off)]
    cols = [pa.array(doc, pa.int64()), pa.array(t, pa.int64()), *small, pa.array(core.view(np.int64)), *(pa.array(np.ascontiguousarray(whole[:, i])) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(cols, ["doc", "t", "start", "n", "off", "core", "w1", "w2"])


def keyed(docs: DataFrame, doc) -> DataFrame:
    """(doc, t, text): t names the text, the same wherever it is scanned."""
    return docs.select(doc.cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def ranges(texts: DataFrame, tokens: Callable, width: int, k: int, bits: int = 64) -> DataFrame:
    """The anchored ranges of all texts: rows ``ROWS``.  ``tokens`` makes ``Tokens`` of a text.  Fewer ``bits``
    of the cores only make more classes that have to be split."""

    def run(batches):
        for b in batches:
            docs, ts, all_ = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for at, part in parts(all_):
                got = []
                for i, x in enumerate(part, at):
                    r = anchored(tokens(x), width, k)
                    if len(r[0]):
                        got.append((np.full(len(r[0]), docs[i]), np.full(len(r[0]), ts[i]), *r))
                if got:
                    yield _batch(bits, *(np.concatenate(x) for x in zip(*got)))

    return texts.select("doc", "t", "text").mapInArrow(run, ROWS)


def _split_rows(texts: DataFrame, mixed: DataFrame, tokens: Callable, width: int, step: int, bits: int) -> DataFrame:
    """The ranges ``mixed`` (doc, t, start, n, off, core) of these texts, split."""
    by = mixed.groupBy("doc", "t").agg(F.collect_set(F.struct("start", "n", "off", "core")).alias("parts"), F.count("*").alias("size"))
    by = written(by, "repeat-parts")
    found = _matched(texts, by, "size", "inner")

    def run(batches):
        for b in batches:
            docs, ts, all_, lists = (b.column(i).to_pylist() for i in range(4))
            for at, part in parts(all_):
                got = []
                for i, x in enumerate(part, at):
                    own = tokens(x)
                    for p in lists[i]:
                        r = split(own, width, step, p["start"], p["n"], p["off"], p["core"])
                        got.append((np.full(len(r[0]), docs[i]), np.full(len(r[0]), ts[i]), *r))
                if got:
                    yield _batch(bits, *(np.concatenate(x) for x in zip(*got)))

    return found.select("doc", "t", "text", "parts").mapInArrow(run, ROWS)


def _matched(texts: DataFrame, by: DataFrame, size: str, how: str) -> DataFrame:
    """``texts`` joined with a written table of one row per text, broadcast only if it is small: a row takes
    about 100 bytes and each of its ``size`` spans up to 48."""
    n = by.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("spans")).first()
    if 100 * n["rows"] + 48 * n["spans"] <= BROADCAST_BYTES:
        by = F.broadcast(by)
    return texts.join(by.drop(size), ["doc", "t"], how)


def repeated(rows: DataFrame, texts: DataFrame, tokens: Callable, width: int, steps: tuple, earlier: bool, bits: int = 64) -> list[DataFrame]:
    """The repeated ranges among ``rows``, as tables (doc, t, start, n) whose union has them all.

    ``earlier``: a window counts as repeated in a document if it also starts in one of a smaller
    ``doc``; otherwise if it starts anywhere else.  ``steps``: the lengths of ranges in later passes,
    the last of them 1."""
    counts = [F.count("*").alias("many"), F.min("doc").alias("d0"), F.max("doc").alias("d1")]
    again = (F.col("d0") < F.col("d1")) if earlier else (F.col("many") > 1)
    if not steps:  # single windows: groups of equal bytes
        met = rows.join(rows.groupBy("w1", "w2").agg(*counts).filter(again).select("w1", "w2", "d0"), ["w1", "w2"])
        return [(met.filter(F.col("doc") > F.col("d0")) if earlier else met).select("doc", "t", "start", "n")]
    by_core = rows.groupBy("core").agg(*counts, *[f(c).alias(f"{f.__name__}_{c}") for c in ("w1", "w2") for f in (F.min, F.max)])
    mixed = (F.col("min_w1") != F.col("max_w1")) | (F.col("min_w2") != F.col("max_w2"))
    by_core = by_core.filter(again).select("core", "d0", mixed.alias("mixed"))
    met = rows.join(by_core, "core")
    if earlier:
        met = met.filter(F.col("mixed") | (F.col("doc") > F.col("d0")))
    if_mixed = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)
    met = written(met.select("doc", "t", "start", "n", *map(if_mixed, ("off", "core", "w1", "w2"))), "repeat-met")
    settled = met.filter(F.col("core").isNull()).select("doc", "t", "start", "n")
    mixed = met.filter(F.col("core").isNotNull())
    least = F.min(F.struct("doc", "t", "start", "n", "off")).alias("least")
    key = ["core", "w1", "w2"]
    wholes = mixed.groupBy(*key).agg(F.count("*").alias("many"), least)
    wholes = written(wholes, "repeat-wholes")
    if wholes.isEmpty():
        return [settled]
    more = mixed.join(wholes, key)
    done = more.filter(F.col("doc") > F.col("least.doc") if earlier else F.col("many") > 1).select("doc", "t", "start", "n")
    if earlier:  # the smallest document's own ranges may still have windows of other wholes
        parts = more.filter(F.col("doc") == F.col("least.doc")).select("doc", "t", "start", "n", "off", "core")
    else:  # one range stands for a settled whole, so that others can be found to share its windows
        parts = wholes.select("least.*", "core")
    finer = _split_rows(texts, parts, tokens, width, steps[0], bits)
    finer = written(finer if len(steps) > 1 else finer.drop("core", "off"), "repeat-finer")  # it is read twice, and texts only once
    return [settled, done, *repeated(finer, texts, tokens, width, steps[1:], earlier, bits)]


def merged(found: list[DataFrame], width: int) -> DataFrame:
    """One row per text with repeats: (doc, t, starts, ends, n_spans), the covered runs of tokens in order."""
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    by = all_.groupBy("doc", "t").agg(F.collect_set(F.struct("start", "n")).alias("got"))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = start + flat.field(1).to_numpy(zero_copy_only=False) - 1 + width
            offsets = offsets - offsets[0]
            starts, ends = [], []
            for i in range(len(lists)):
                a, z = start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]
                o = np.argsort(a, kind="stable")
                a, z = a[o], np.maximum.accumulate(z[o])
                new = np.concatenate([[True], a[1:] > z[:-1]])
                starts.append(a[new])
                ends.append(z[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(starts, kind), pa.array(ends, kind), pa.array([len(x) for x in starts], pa.int64())],
                ["doc", "t", "starts", "ends", "n_spans"])

    return written(by.mapInArrow(run, "doc long, t long, starts array<long>, ends array<long>, n_spans long"), "repeat-spans")


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """All texts with their spans (null: none)."""
    by = spans.withColumn("size", F.col("n_spans"))
    return _matched(texts, by, "size", "left")
