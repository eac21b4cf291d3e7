"""Operator 8: language-model scoring by a probabilistic suffix tree over the running text's bytes.

A text is its words in lower case (A-Z), one blank between them, and a line feed, the end.  Symbols
are its bytes; the context of a symbol are the DEPTH bytes before it, across words.  Of every
context the counts of the next symbols are gathered from all training texts.  A context is retained
if its next symbols diverge enough from those of the context that is one byte shorter; a symbol's
probability is that after the longest retained suffix of what came before, smoothed towards the
next shorter retained one and so on to the empty context.  The tree has no bound but the corpus:
counts, retained contexts and the values of windows are partitioned tables."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_CODES, Prefix, bucket_of, scan, utf8, written

#: Bytes of context.  A window is a symbol and its context, packed in an integer, the symbol lowest.
DEPTH = 5
#: A context is a candidate if it was seen so often, whatever the corpus: the tree grows with it.
LEAST = 2
#: A context is retained if its next symbols diverge from those of the next shorter one by so many nats in all.
DIVERGENCE = 6.0
#: Words and windows with at least 1 / FREQUENT of all occurrences, so at most FREQUENT of each, are
#: looked up in broadcast arrays of 16 bytes an entry; the others' values are joined.
FREQUENT = 4_000_000
CHUNK = 1 << 20  # bytes that are worked on at once
ROWS = 500_000  # rows that are worked on at once
HELD = 1_500_000  # counts that a task holds before it passes them on
FIT = 1 << 30  # occurrences after which a task passes its counts on: half a number holds them and those of one text
PAD = 0x0D  # stands before a text; no text in this form has it
WORD, WINDOW = 0, 1  # kinds of keys

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_HALF, _LOW = np.uint64(32), np.uint64(2**32 - 1)


def canonical(text: str | None) -> bytes:
    return b" ".join(utf8(text).lower().split()) + b"\n"


def _pieces(s: bytes, most: int):
    """(from, to) of consecutive pieces of about ``most`` bytes that end after a blank; a longer word is whole."""
    a = 0
    while len(s) - a > most:
        z = s.rfind(b" ", a, a + most) + 1 or s.find(b" ", a + most) + 1 or len(s)
        yield a, z
        a = z
    if a < len(s):
        yield a, len(s)


class Chunk:
    """Pieces of texts in one buffer: ``doc`` (the text of each piece), ``win`` (the windows of all symbols),
    ``at`` (where each piece's windows begin), ``words`` (hashes) and ``ends`` (words up to each piece's end)."""

    def __init__(self, docs: list[int], parts: list[tuple[bytes, bytes]]):
        self.doc = np.array(docs, np.int64)
        buf = np.frombuffer(b"".join([x for p in parts for x in p]), np.uint8)
        sizes = np.fromiter((len(p[1]) for p in parts), np.int64, len(parts))
        first = np.cumsum(sizes + DEPTH) - sizes  # of each piece the place of its first symbol
        own = np.ones(len(buf), bool)
        own[(first[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
        wide = buf.astype(np.uint64)
        win = wide.copy()
        for k in range(1, DEPTH + 1):
            win[k:] |= wide[: len(buf) - k] << np.uint64(8 * k)
        self.win, self.at = win[own], np.cumsum(sizes) - sizes
        blank = ~own | (buf == 32) | (buf == 10)
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.words = np.minimum(Prefix(BYTE_CODES[buf]).runs(start, end), _NONE - np.uint64(1))
        self.ends = np.searchsorted(start, first + sizes)

    def sums(self, of_words: np.ndarray, n: int) -> np.ndarray:
        """Sums of a value of each word, by text."""
        total = np.concatenate([[0.0], np.cumsum(of_words)])[self.ends]
        return np.bincount(self.doc, np.diff(total, prepend=0.0), n)

    def places(self, of: np.ndarray, which: int) -> np.ndarray:
        """The texts of the words, or windows, with these numbers."""
        if which == WORD:
            return self.doc[np.searchsorted(self.ends, of, "right")]
        return self.doc[np.searchsorted(self.at, of, "right") - 1]


def chunks(texts: list):
    docs, parts, size = [], [], 0
    for i, t in enumerate(texts):
        s = canonical(t)
        for a, z in _pieces(s, CHUNK):
            docs.append(i)
            parts.append((s[max(0, a - DEPTH) : a].rjust(DEPTH, bytes([PAD])), s[a:z]))
            size += z - a
            if size >= CHUNK:
                yield Chunk(docs, parts)
                docs, parts, size = [], [], 0
    if parts:
        yield Chunk(docs, parts)


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can: a worker that waits holds no more than it needs."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _slices(batch, text: int):
    """Consecutive rows of about CHUNK bytes of text, so that memory doesn't follow the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = (np.cumsum(size) - size) // CHUNK
    cut = [0, *(np.flatnonzero(np.diff(begin)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cut, cut[1:]):
        if a < z:
            yield batch.slice(a, z - a)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple:
    """Distinct keys in order and the sums of each one's counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _merged(held: list) -> tuple:
    """The same of pairs (keys, counts), which are let go as they are joined: no more than half of them is there twice."""
    keys = np.concatenate([k for k, _ in held])
    held[:] = [c for _, c in held]
    counts = np.concatenate(held)
    held.clear()
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first]
    return keys, np.add.reduceat(counts, first)


def counted(docs: DataFrame) -> DataFrame:
    """(kind, key, c, n): how often each word and window occurs in rows (text, learn) that are learned
    from, and in all; summed within tasks before the shuffle.  A task holds HELD counts of both kinds together,
    c and n in one number, c in its upper half."""

    def run(batches):
        _forget()
        held, size, seen = ([], []), [0, 0], [0, 0]

        def add(kind, keys, learn):
            if not len(keys):
                return
            u, n = np.unique(keys, return_counts=True)
            n = n.view(np.uint64)
            held[kind].append((u, n | n << _HALF if learn else n))
            size[kind] += len(u)
            seen[kind] += len(keys)

        def out(last):
            if sum(size) <= 2 * HELD and max(seen) < FIT and not last:
                return
            for kind in (WORD, WINDOW):
                if len(held[kind]) > 1:
                    held[kind].append(_merged(held[kind]))
                    size[kind] = len(held[kind][0][0])
            if not last and sum(size) <= HELD and max(seen) < FIT:
                return
            for kind in (WORD, WINDOW):
                size[kind] = seen[kind] = 0
                while held[kind]:
                    keys, both = held[kind].pop()
                    for a in range(0, len(keys), ROWS):
                        k, x = keys[a : a + ROWS], both[a : a + ROWS]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array((x >> _HALF).view(np.int64)), pa.array((x & _LOW).view(np.int64))], ["kind", "key", "c", "n"])

        for batch in batches:
            for b in _slices(batch, 0):
                texts, learn = b.column(0).to_pylist(), b.column(1).to_pylist()
                for flag in (1, 0):
                    for x in chunks([t for t, v in zip(texts, learn) if bool(v) == flag]):
                        add(WORD, x.words, flag)
                        add(WINDOW, x.win, flag)
                        del x
                        yield from out(False)
        yield from out(True)
        _trim()

    got = docs.select("text", "learn").mapInArrow(run, "kind int, key long, c long, n long")
    return written(got.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "pst-counts")


def _mask(d: int) -> np.uint64:
    """Of a window the symbol and the d symbols before it."""
    return np.uint64((1 << 8 * (d + 1)) - 1)


def _contexts(win: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order: the contexts, where each begins, the sum of each one's counts."""
    ctx = win >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    return ctx[first], first, np.add.reduceat(c, first)


def _kept(d: int, level: tuple, up: tuple, least: float, divergence: float) -> np.ndarray:
    """Which windows of length d are of a retained context; ``up`` has all those of length d - 1."""
    (win, c), (uwin, uc) = level, up
    if not len(win):
        return np.zeros(0, bool)
    _, first, n = _contexts(win, c)
    size = np.diff(np.append(first, len(win)))
    _, ufirst, un = _contexts(uwin, uc)
    total = np.repeat(un, np.diff(np.append(ufirst, len(uwin))))
    i = np.searchsorted(uwin, win & _mask(d - 1))
    gain = np.add.reduceat(c * (np.log(c / np.repeat(n, size)) - np.log(uc[i] / total[i])), first)
    return np.repeat((n >= least) & (gain >= divergence), size)


def _probabilities(win: np.ndarray, levels: list) -> np.ndarray:
    """Of each window the probability of its symbol after the longest retained suffix of its context."""
    p = np.full(len(win), 1 / 256)
    for d, (keys, c) in enumerate(levels):
        if not len(keys) or not len(win):
            continue
        ctx, first, n = _contexts(keys, c)
        kinds = np.diff(np.append(first, len(keys)))
        w = win & _mask(d)
        i = np.minimum(np.searchsorted(ctx, w >> np.uint64(8)), len(ctx) - 1)
        j = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
        here = np.where(keys[j] == w, c[j], 0)
        p = np.where(ctx[i] == w >> np.uint64(8), (here + kinds[i] * p) / (n[i] + kinds[i]), p)
    return p


def _group():
    """The two last symbols of a context: no context of two symbols or more needs another group's."""
    return F.shiftrightunsigned("win", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("g")


class Tree:
    """The retained contexts of counts (win, c): those of at most one symbol as arrays, at most 2 ** 16
    windows, the others as a table (g, d, win, c) of their windows, which is joined to what is to be scored."""

    def __init__(self, counts: DataFrame, least: float = LEAST, divergence: float = DIVERGENCE):
        one = counts.groupBy(F.col("win").bitwiseAND(F.lit(0xFFFF)).alias("win")).agg(F.sum("c").alias("c")).toPandas()
        one = _summed(one["win"].to_numpy(np.int64).view(np.uint64), one["c"].to_numpy(np.int64))
        none = _summed(one[0] & _mask(0), one[1])
        keep = _kept(1, one, none, least, divergence)
        self.top = [none, (one[0][keep], one[1][keep])]

        def run(batches):
            for g, win, c in _whole(batches):
                up, win = one, win.view(np.uint64)
                for d in range(2, DEPTH + 1):
                    level = _summed(win & _mask(d), c)
                    k = _kept(d, level, up, least, divergence)
                    at = level[0][k]
                    yield pa.RecordBatch.from_arrays([
                        pa.array((at >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int32)), pa.array(np.full(len(at), d, np.int32)),
                        pa.array(at.view(np.int64)), pa.array(level[1][k])], ["g", "d", "win", "c"])
                    up = level

        rows = counts.select(_group(), "win", "c").repartition("g").sortWithinPartitions("g")
        self.table = written(rows.mapInArrow(run, "g int, d int, win long, c long"), "pst-tree")

    def scored(self, windows: DataFrame) -> DataFrame:
        """(win, n) -> (win, n, score): log10 of the probability of each window's symbol after its context."""
        top = self.top

        def look(batches):
            held = [np.zeros(0, np.int64)] * 4
            new, size = [], 0

            def work(held, new):
                g, d, win, c = (np.concatenate([x, *y]) for x, y in zip(held, zip(*new)))
                win, levels = win.view(np.uint64), list(top)
                for k in range(2, DEPTH + 1):
                    on = d == k
                    order = np.argsort(win[on])
                    levels.append((win[on][order], c[on][order]))
                on = d > DEPTH
                p = np.log10(_probabilities(win[on], levels))
                last = (g == g[-1]) & ~on  # this group may go on
                got = pa.RecordBatch.from_arrays([pa.array(win[on].view(np.int64)), pa.array(c[on]), pa.array(p)], ["win", "n", "score"])
                return [x[last] for x in (g, d, win.view(np.int64), c)], got

            for b in batches:
                new.append([b.column(i).to_numpy() for i in range(4)])
                size += b.num_rows
                if size >= ROWS:
                    held, out = work(held, new)
                    new, size = [], 0
                    yield out
            if size:
                yield work(held, new)[1]
            _trim()

        rows = windows.select(_group(), F.lit(DEPTH + 1).alias("d"), "win", F.col("n").alias("c")).unionByName(self.table)
        rows = rows.repartition("g").sortWithinPartitions("g", "d")  # a group's contexts before what asks for them
        return rows.mapInArrow(look, "win long, n long, score double")


def _whole(batches):
    """Columns of rows that are clustered by the first one, ROWS or more at once, no group cut."""
    held, size = [], 0
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(b.num_columns)]
        if not b.num_rows:
            continue
        size += b.num_rows
        held.append(cols)
        if size >= ROWS:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if cols[0][0] != cols[0][-1] else 0
            if cut:
                yield [x[:cut] for x in cols]
            held = [[x[cut:] for x in cols]]
            size = len(held[0][0]) if cut else 0  # of a larger group, ROWS more before the next look
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


class Table:
    """Numbers by key, in arrays with open addressing: a look-up is a few array operations for any number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values, self.probes = np.full(1 << bits, _NONE), np.zeros(1 << bits), 0
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            self.probes += 1
            won, free = np.zeros(len(at), bool), np.flatnonzero(self.keys[at] == _NONE)
            won[free[np.unique(at[free], return_index=True)[1]]] = True  # of those that want the same free place the first
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _GOLDEN >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, numbers of the keys that aren't there)."""
        at = self._first(keys)
        found = self.keys[at]
        values = self.values[at]
        left = np.flatnonzero(found != keys)
        values[left] = 0.0
        missing = [left[found[left] == _NONE]]
        left = left[found[left] != _NONE]
        at = at[left]
        for _ in range(1, self.probes):
            if not len(left):
                break
            at = (at + 1) & self.last
            found = self.keys[at]
            hit = found == keys[left]
            values[left[hit]] = self.values[at[hit]]
            missing.append(left[found == _NONE])
            go = ~hit & (found != _NONE)
            left, at = left[go], at[go]
        return values, np.concatenate([*missing, left])


_ready: dict = {}


def _forget() -> None:
    """Lets go of the tables that a former query left in this worker."""
    _ready.clear()


def _tables(token: str, known) -> list[Table]:
    """The look-up tables of a broadcast, made once in each worker."""
    if token not in _ready:
        _ready.clear()
        _ready[token] = [Table(*x) for x in known.value]
    return _ready[token]


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_tokens, n_known, train_tokens, base_score, score); the rows for which
    ``learn`` is true are learned from.

    Base: add-one probabilities of words and of the end, counted over all those rows.  Model: the tree of
    the same rows.  A null or empty text is an end alone.  Where nothing is learned the tree is uniform and
    the base score 0; an empty table gives no rows.  Rows are independent, ties don't matter, repeated rows
    repeat and count each; columns other than doc_id and text play no part, whatever their names.  A very long
    text is worked on in pieces.  Words are known by 64-bit hashes."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = counted(docs)
    n_texts = docs.filter("learn").count()
    words, windows = counts.filter(F.col("kind") == WORD), counts.filter(F.col("kind") == WINDOW).withColumnRenamed("key", "win")
    s = counts.groupBy("kind").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()
    s = {r["kind"]: r for r in s}
    n, v = (s[WORD]["c"] + n_texts, s[WORD]["v"] + (n_texts > 0)) if WORD in s else (n_texts, int(n_texts > 0))
    tree = Tree(windows.filter("c > 0").select("win", "c"))
    logs = tree.scored(windows).select(F.lit(WINDOW).alias("kind"), F.col("win").alias("key"), "n", F.col("score").alias("value"))
    values = written(words.select("kind", "key", "n", F.log10(F.col("c") + 1).alias("value")).unionByName(logs), "pst-values")
    often = F.lit(False)
    for kind, r in s.items():
        often |= (F.col("kind") == kind) & (F.col("n") >= max(1.0, r["n"] / FREQUENT))
    got = values.filter(often).select("kind", "key", "value").toPandas()
    known = spark.sparkContext.broadcast([(x["key"].to_numpy(np.int64).view(np.uint64), x["value"].to_numpy(float)) for x in (got[got["kind"] == k] for k in (WORD, WINDOW))])
    whole, end_base = float(np.log10(n + v + 1)), float(np.log10(n_texts + 1))
    token = uuid.uuid4().hex

    def run(batches):
        tables = _tables(token, known)
        for b in (part for batch in batches for part in _slices(batch, 2)):
            texts = b.column(2).to_pylist()
            size = len(texts)
            n, known_, base, model = (np.zeros(size) for _ in range(4))
            rare = []
            for x in chunks(texts):
                lw, more = tables[WORD].get(x.words)
                for total, of in ((n, np.ones(len(x.words))), (known_, lw > 0), (base, lw)):
                    total += x.sums(of, size)
                rare.append((x.places(more, WORD), np.full(len(more), WORD, np.int32), x.words[more]))
                lp, more = tables[WINDOW].get(x.win)
                model += np.bincount(x.doc, np.add.reduceat(lp, x.at), size)
                rare.append((x.places(more, WINDOW), np.full(len(more), WINDOW, np.int32), x.win[more]))
            doc, kind, key = (np.concatenate(y) for y in zip(*rare)) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
            order = np.argsort(doc, kind="stable")
            offsets = np.searchsorted(doc[order], np.arange(size + 1)).astype(np.int32)
            lists = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(key[order].view(np.int64))], ["kind", "key"])
            cols = [
                pa.array(np.rint(n).astype(np.int64) + 1), pa.array(np.rint(known_).astype(np.int64) + (n_texts > 0)), pa.array(base + end_base - (n + 1) * whole), pa.array(model),
                pa.ListArray.from_arrays(pa.array(offsets), lists)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])
        _trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    rows = written(rows.mapInArrow(run, f"rid long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<kind: int, key: long>>"), "pst-rows")
    rare = rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.kind", "r.key")
    more = rare.join(values.filter(~often).select("kind", "key", "value"), ["kind", "key"])
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0))
    more = more.groupBy("rid").agg(of(WORD).alias("b"), of(WINDOW).alias("p"), F.count_if((F.col("kind") == WORD) & (F.col("value") > 0)).alias("k"))
    plus = lambda c, x: F.col(c) + F.coalesce(F.col(x), F.lit(0).cast(rows.schema[c].dataType))
    return rows.drop("rare").join(more, "rid", "left").select(
        "doc_id", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base_score", "b").alias("base_score"), plus("score", "p").alias("score"))


def op8_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir).select("doc_id", "text")
    held = bucket_of(F.col("doc_id"), 7) == 2
    return score(docs, ~held).withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
