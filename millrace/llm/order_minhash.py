"""Operator 5: near-duplicates by order MinHash, verified by banded alignment.

Texts are equal (by MD5) or near: their words align with at most 20 % edits of the longer one.
Candidates agree in a sketch: of each of ``SKETCHES`` hash functions the ``MINIMA`` least five-word
shingles, each labelled with its how-manieth occurrence it is, *in text order*.  Two texts with a
share J of their shingles in common and in the same order agree in one sketch with probability
about J^MINIMA.  Shingles are broken by edits faster than words: at random edits of a share e, J is
about x / (2 - x) with x = (1 - e)^5, so of pairs with 10 % edits 1 in 1e5 is missed, with 15 % 1 in
150, with 18 % 1 in 20, with 20 %, the last that are near, 1 in 7; a class that has other links is
whole nevertheless."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Prefix, WordHashes, mix64, parts, scan, utf8, written
from millrace.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 64
MINIMA = 2
#: Of the least shingles of all hash functions, so many must agree for two texts of one bucket to be aligned.
AGREE = 8
#: Buckets of more texts are worked on in salted parts whose leaders then meet.
SALTED = 2000
BLOCK = 1 << 17  # products of shingles and factors worked on at once: they stay in the cache
LONG = 20_000  # words from which an alignment from anchor to anchor is tried first
SHORT = 64  # words up to which a pair is aligned at once
FEW, MASKS = 8, 1 << 31  # places up to which a word's mask is not kept, bits of masks that are
#: Texts of at most so many candidates are picked by a broadcast of their names, more by a shuffle.
BROADCAST_NODES = 500_000

_rng = np.random.default_rng(991)
_FACTORS = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hashes = WordHashes()


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles in text order, equal ones told apart by their occurrence."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    p, at = Prefix(_hashes.of(words)), np.arange(len(words) - k + 1)
    h = p.runs(at, at + k)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if not first.all():
        start = np.maximum.accumulate(np.where(first, at, 0))
        nth = np.empty(len(h), np.uint64)
        nth[order] = (at - start).astype(np.uint64)
        h = mix64(h + nth * np.uint64(0x9E3779B97F4A7C15))
    return h


def sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys of all sketches, 8 bits of each hash function's least shingle)."""
    keys, least = np.zeros(SKETCHES, np.uint64), np.zeros(SKETCHES, np.uint8)
    if not len(h):
        return keys[:0], least
    many = max(1, BLOCK // len(h))
    for a in range(0, SKETCHES, many):
        x = h[None, :] * _FACTORS[a : a + many, None]
        every = np.arange(len(x))
        top = np.empty((len(x), min(MINIMA, len(h))), np.int64)
        for j in range(top.shape[1]):
            top[:, j] = x.argmin(1)
            x[every, top[:, j]] = 2**64 - 1
        least[a : a + many] = (h[top[:, 0]] & np.uint64(0xFF)).astype(np.uint8)
        got = h[np.sort(top, axis=1)]  # in text order
        key = every.astype(np.uint64) + np.uint64(a)
        for j in range(top.shape[1]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + got[:, j])
        keys[a : a + many] = key
    return keys, least


def _band(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance if it is at most ``most``, else more than ``most``: bit-parallel over a band of
    2 * most + 2 diagonals, one row per word of ``b``.  Needs len(a) >= len(b) and most <= len(a)."""
    if not len(b):
        return len(a)
    width = 2 * most + 2
    full = (1 << width) - 1
    top, side = 1 << (width - 1), 1 << (width - 2)
    where: dict = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    masks: dict = {}  # of words with many places: [where the mask begins, mask, places in it so far]
    vp, vn = (full << (width - most - 1)) & full, 0
    dist, start = most, most + 1 - width
    turn = len(a) - most
    for i, x in enumerate(b.tolist()):
        at, m = where.get(x), 0
        if at is None:
            pass
        elif len(at) <= FEW:
            for k in at:
                if start <= k < start + width:
                    m |= 1 << (k - start)
        else:
            got = masks.get(x)
            if got is None:
                if len(masks) * width > MASKS:
                    masks.clear()
                got = masks[x] = [start, 0, bisect_left(at, start)]
            m, n = got[1] >> (start - got[0]), got[2]
            while n < len(at) and at[n] < start + width:
                if at[n] >= start:
                    m |= 1 << (at[n] - start)
                n += 1
            got[:] = start, m, n
        d0 = ((((m & vp) + vp) & full) ^ vp) | m | vn
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < turn:
            dist += not d0 & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
        start += 1
    return dist


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    i = int(d[0]) if len(d) else n
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    d = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    j = int(d[0]) if len(d) else n
    return a[: len(a) - j], b[: len(b) - j]


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits between two texts if at most ``most`` (else some number above it).  Texts of over
    ``LONG`` words are first aligned between shingles that each has just once.  Those edits are an upper
    bound, which is given if it is at most ``most``; otherwise the band decides, growing from a small one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    a, b = _trim(a, b)
    if not len(a) or not len(b):
        return max(len(a), len(b))
    most = min(most, len(a))
    least = _unmatched(a, b) if len(a) > SHORT else 0
    if least > most:
        return least
    if len(a) <= LONG:
        return _band(a, b, most)
    bound = _anchored(a, b, most)
    if bound <= most:
        return bound
    width = min(most, max(64, 2 * least))
    while (d := _band(a, b, width)) > width and width < most:
        width = min(most, 4 * width)
    return d


def _unmatched(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longer text that have no partner in the other one, wherever it stands: a lower bound of the edits."""
    words, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(n[: len(a)], minlength=len(words)) - np.bincount(n[len(a) :], minlength=len(words))
    return int(np.maximum(more, 0).sum())


def _anchored(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """An upper bound of the edits, from the longest chain of shingles that each text has just once; needs
    len(a) >= len(b).  Some number above ``most`` if it isn't at most that."""
    at = []
    for x in (a, b):
        i = np.arange(max(0, len(x) - SHINGLE + 1))
        v, first, n = np.unique(Prefix(mix64(x.astype(np.uint64))).runs(i, i + SHINGLE), return_index=True, return_counts=True)
        at.append((v[n == 1], first[n == 1]))
    _, i, j = np.intersect1d(at[0][0], at[1][0], assume_unique=True, return_indices=True)
    pa_, pb = at[0][1][i], at[1][1][j]
    order = np.argsort(pa_)
    pa_, pb = pa_[order], pb[order]
    ends, back, prev = [], [], np.full(len(pb), -1)
    for k, y in enumerate(pb.tolist()):  # longest chain of anchors in both orders
        c = bisect_left(ends, y)
        prev[k] = back[c - 1] if c else -1
        if c == len(ends):
            ends.append(y)
            back.append(k)
        else:
            ends[c], back[c] = y, k
    chain, k = [], back[-1] if back else -1
    while k >= 0:
        chain.append(k)
        k = prev[k]
    total, x0, y0 = 0, 0, 0
    for k in [*reversed(chain), -1]:
        x1, y1 = (int(pa_[k]), int(pb[k])) if k >= 0 else (len(a), len(b))
        if x1 < x0 or y1 < y0:
            continue
        g, h = _trim(a[x0:x1], b[y0:y1])
        if len(g) < len(h):
            g, h = h, g
        total += len(g) if not len(h) or len(g) > LONG else _band(g, h, len(g))
        if total > most:
            return total
        x0, y0 = (x1 + 1, y1 + 1) if k >= 0 else (x1, y1)
    return total


def similar(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> bool:
    n = max(len(a), len(b))
    most = int((1 - at_least) * n + 1e-9)
    return edits(a, b, most) <= most


def named(docs: DataFrame) -> DataFrame:
    """Non-null texts with ``node``, the name of the text: equal texts, equal names."""
    return docs.filter(F.col("text").isNotNull()).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, keys, least) of every text with a shingle, once per text."""

    def run(batches):
        seen: set = set()
        for b in batches:
            nodes, all_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, part in parts(all_):
                out = [[], [], [], []]
                for i, x in enumerate(part, at):
                    if nodes[i] in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(nodes[i])
                    words = utf8(x).split()
                    keys, least = sketch(shingles(words))
                    if len(keys):
                        for o, v in zip(out, (nodes[i], len(words), keys.view(np.int64), least.tobytes())):
                            o.append(v)
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["node", "n", "keys", "least"])

    got = texts.select("node", "text").mapInArrow(run, "node binary, n long, keys array<long>, least binary")
    return written(got.dropDuplicates(["node"]), "omh-sketches")


def _leaders(rows: DataFrame, salted: bool) -> DataFrame:
    """Streams over the texts of each bucket in order: a text is paired with every leader that it
    agrees with, and leads itself if there is none.  Memory holds the leaders only.

    Rows (key, salt, many, node, n, least), clustered and sorted; gives (a, b) pairs and, of salted
    buckets, the leaders again as (key, many, node, n, least)."""
    schema = "a binary, b binary, key long, node binary, n long, least binary"
    alike = SIMILARITY

    def run(batches):
        group, names, sizes, mins, used = None, [], np.zeros(64), np.zeros((64, SKETCHES), np.uint8), 0
        for b in batches:
            out = [[] for _ in range(6)]
            cols = [b.column(i).to_pylist() for i in range(6)]
            for key, salt, many, node, n, least in zip(*cols):
                if (key, salt) != group:
                    group, names, used = (key, salt), [], 0
                m = np.frombuffer(least, np.uint8)
                near = np.zeros(0, int)
                if used:
                    s = sizes[:used]
                    near = np.flatnonzero(((mins[:used] == m).sum(1) >= AGREE) & (s >= alike * n) & (n >= alike * s))
                for j in near.tolist():
                    for o, v in zip(out, (names[j], node, None, None, None, None)):
                        o.append(v)
                if not len(near):
                    if used == len(sizes):
                        sizes, mins = np.concatenate([sizes, np.zeros(used)]), np.concatenate([mins, np.zeros((used, SKETCHES), np.uint8)])
                    sizes[used], mins[used] = n, m
                    names.append(node)
                    used += 1
                    if salted and many > SALTED:
                        for o, v in zip(out, (None, None, key, node, n, least)):
                            o.append(v)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["a", "b", "key", "node", "n", "least"])

    rows = rows.select("key", "salt", "many", "node", "n", "least")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(run, schema)


def buckets(known: DataFrame) -> DataFrame:
    """(key, nid, many): the texts of every bucket that has more than one.  ``nid``, a 64-bit hash of the name,
    keeps the rows small; two texts that share one are both aligned."""
    by = known.select(F.xxhash64("node").alias("nid"), F.explode("keys").alias("key"))
    keys = by.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    return written(by.join(keys, "key"), "omh-buckets")


def candidates(known: DataFrame, met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of text names to align first: within a bucket not all pairs, but each text
    with the leaders it agrees with.  What they leave open, ``further`` gives."""
    met = met.join(known.select(F.xxhash64("node").alias("nid"), "node", "n", "least"), "nid")
    parts = F.ceil(F.col("many") / SALTED)
    met = met.withColumn("salt", F.when(F.col("many") > SALTED, F.pmod(F.xxhash64("node", "key"), parts)).otherwise(F.lit(0)))
    first = written(_leaders(met, True), "omh-leaders")
    again = first.filter(F.col("key").isNotNull()).select("key", F.lit(0).cast("long").alias("salt"), F.lit(0).cast("long").alias("many"), "node", "n", "least")
    pairs = first.filter(F.col("a").isNotNull()).select("a", "b")
    pairs = pairs.unionByName(_leaders(again, False).filter(F.col("a").isNotNull()).select("a", "b"))
    return written(pairs.distinct(), "omh-pairs")


def further(known: DataFrame, met: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) still to align after the leaders' ones: texts of one bucket that agree, as
    leaders and theirs do, but are in different classes.  With them every agreeing pair of a
    bucket has been aligned or is linked already."""
    by = met.filter("many > 2").select("key", "nid")  # two have met
    own = known.select(F.xxhash64("node").alias("nid"), "node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own, "omh-own")
    by = by.join(own.select("nid", F.xxhash64("root").alias("rid")), "nid")
    open_ = by.groupBy("key").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).filter("x <> y").select("key")
    met = by.select("key", "nid").distinct().join(open_, "key").join(own, "nid").select("key", "node", "n", "least", "root")

    def run(batches):
        group, names, used = None, [], 0
        ids: dict = {}
        sizes, mins, cls = np.zeros(64), np.zeros((64, SKETCHES), np.uint8), np.zeros(64, np.int64)
        for b in batches:
            out = [[], []]
            for key, node, n, least, root in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if key != group:
                    group, names, used, ids = key, [], 0, {}
                m, r = np.frombuffer(least, np.uint8), ids.setdefault(root, len(ids))
                s = sizes[:used]
                near = np.flatnonzero((cls[:used] != r) & (s >= SIMILARITY * n) & (n >= SIMILARITY * s))
                near = near[(mins[near] == m).sum(1) >= AGREE]
                out[0] += [names[j] for j in near.tolist()]
                out[1] += [node] * len(near)
                if used == len(sizes):
                    sizes, mins, cls = (np.concatenate([x, np.zeros_like(x)]) for x in (sizes, mins, cls))
                sizes[used], mins[used], cls[used] = n, m, r
                names.append(node)
                used += 1
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary()) for o in out], ["a", "b"])
                    out = [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary()) for o in out], ["a", "b"])

    got = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a binary, b binary").distinct()
    return written(got.join(done, ["a", "b"], "left_anti"), "omh-further")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts align.  Only texts of candidates are moved, as 32-bit word hashes."""
    nodes = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "omh-nodes")
    small = nodes.count() <= BROADCAST_NODES
    own = texts.select("node", "text").join(F.broadcast(nodes) if small else nodes, "node", "left_semi")

    def words(batches):
        seen: set = set()
        for b in batches:
            nodes, all_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, part in parts(all_):
                out = [[], []]
                for i, x in enumerate(part, at):
                    if nodes[i] not in seen:
                        seen.add(nodes[i])
                        out[0].append(nodes[i])
                        out[1].append(_hashes.of(utf8(x).split()).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary()) for o in out], ["node", "words"])

    tokens = written(own.mapInArrow(words, "node binary, words binary").dropDuplicates(["node"]), "omh-words")
    both = pairs.join(tokens.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    both = both.join(tokens.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")

    def align(batches):
        for b in batches:
            a, c, wa, wb = (b.column(i) for i in range(4))
            ok = [similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(wa, wb)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], ["u", "v"])

    return both.select("a", "b", "wa", "wb").mapInArrow(align, "u binary, v binary")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, root, class_id): class_id is the smallest doc_id among near and equal texts, linked
    through others where needed.

    A null text is near nothing, its class_id is its own doc_id and its node null.  Texts of fewer
    than five words (empty ones too) are only equal or not.  A class without a doc_id has a null
    class_id.  Extra columns play no part, whatever their names; repeated rows are in one class; an empty
    table gives no rows.  Texts of any length are aligned whole."""
    texts = named(docs.select("doc_id", "text"))
    known = sketches(texts)
    met = buckets(known)
    pairs = candidates(known, met)
    links = written(verified(texts, pairs), "omh-links")
    roots = components(links)
    more = further(known, met, roots, pairs)
    if not more.isEmpty():
        roots = components(links.unionByName(verified(texts, more)))
    ids = written(texts.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "omh-ids")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = ids.join(least, "root").select("doc_id", "node", "root", "class_id")
    none = F.lit(None).cast("binary")
    null = docs.filter(F.col("text").isNull()).select("doc_id", none.alias("node"), none.alias("root"), F.col("doc_id").alias("class_id"))
    return out.unionByName(null)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the smallest doc_id, null texts all.

    Rows that are equal in doc_id and text are one document, of which one row stays; of texts
    that share the smallest doc_id, or have none, the least by MD5.  Other columns pass through, whatever
    their names; an empty table stays empty."""
    got = classes(docs).filter(F.col("node").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    keep = got.groupBy("root").agg(first).select("first.*")
    keep = written(keep.select("doc_id", "node"), "omh-kept")
    have = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    on = have["doc_id"].eqNullSafe(keep["doc_id"]) & (have["node"] == keep["node"])
    stay = have.join(keep, on, "left_semi").dropDuplicates(["doc_id", "node"]).select("row.*")
    return stay.unionByName(docs.filter(F.col("text").isNull()))


def op5_order_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(scan(spark, sf_dir)).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
