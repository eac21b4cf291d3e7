"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.
DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, scan, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketches of at most so many hashes are broadcast to the shingles of the documents; larger ones,
#: and candidates of more documents than this, meet them in a shuffle join.
BROADCAST_HASHES = 1_000_000
BROADCAST_DOCS = 500_000


def words(text: str = "text") -> Column:
    return F.expr(f"array_remove(split(coalesce({text}, ''), '[{BLANKS}]+'), '')".replace("\\", "\\\\"))


def _hashes(w: str = "w") -> Column:
    each = ", ".join(f"{w}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({w}) < {SHINGLE} THEN cast(array() as array<bigint>) ELSE transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({each})) END")


def _texts(w: str = "w") -> Column:
    each = ", ".join(f"{w}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({w}) < {SHINGLE} THEN cast(array() as array<string>) ELSE array_distinct(transform(sequence(0, size({w}) - {SHINGLE}), i -> concat_ws(' ', {each}))) END")


def items_of(benchmark: DataFrame, at_least: float = CONTAINMENT) -> DataFrame:
    """(item_id, shingles, n, part, need, sketch) of the items that have a shingle.

    A text that contains ``at_least`` of an item's n shingles lacks n - need of them at most, so it
    has one of any n - need + 1: of the least by hash, the item's MinHash sketch.  Items are
    partitioned by size in powers of two (``part``): what follows for a partition's search is in ``reach``."""
    i = benchmark.select("item_id", words().alias("w")).select("item_id", _texts().alias("shingles"), _hashes().alias("h"))
    i = i.filter(F.size("shingles") > 0).select("item_id", "shingles", F.size("shingles").alias("n"), F.expr("sort_array(array_distinct(h))").alias("h"))
    i = i.withColumn("need", F.ceil(F.col("n") * F.lit(at_least) - F.lit(1e-9)).cast("int"))
    i = i.withColumn("part", F.floor(F.log2("n")).cast("int"))
    return i.withColumn("sketch", F.expr("slice(h, 1, n - need + 1)")).drop("h")


def reach(items: DataFrame) -> list[tuple[int, int]]:
    """Of each partition in order of size (least need, largest hash in a sketch).  Only documents of ``need``
    shingles or more can contain one of its items, and only shingles up to that hash are in its sketches."""
    p = items.groupBy("part").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("cut"))
    return [(r["need"], r["cut"]) for r in p.orderBy("part").collect()]  # 31 rows at most


def leaks(docs: DataFrame, benchmark: DataFrame, at_least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that contain at least
    ``at_least`` of an item's distinct five-word shingles; words are compared as they are.

    Items of fewer than five words and null texts have no shingles: they are found nowhere and contain
    nothing.  Items of one id but different texts are searched each, repeated item rows once; of
    repeated document rows each distinct one counts once.  Long documents are searched whole: the
    search is by shingle, so their length plays no part.  Empty tables give no rows; columns other than those
    named play no part, whatever their names."""
    items = written(items_of(benchmark.select("item_id", "text").distinct(), at_least).withColumn("key", F.xxhash64("item_id", "shingles")), "leak-items")
    sketch = items.select("key", "need", F.explode("sketch").alias("hash"))
    text = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    text = text.withColumn("name", F.xxhash64("text"))
    # a document looks in the partitions whose items it is large enough for
    m, cut = F.size("h"), F.lit(-(2**63))
    for need, most in reach(items):
        cut = F.when(m >= need, F.greatest(cut, F.lit(most))).otherwise(cut)
    # each in a generator: filters can't be pushed below one, where they would work the arrays out anew
    own = text.select("doc_id", "name", F.explode(F.array(words())).alias("w")).select("doc_id", "name", F.explode(F.array(_hashes())).alias("h"))
    own = own.select("doc_id", "name", m.alias("m"), cut.alias("cut"), F.explode("h").alias("hash")).filter("hash <= cut").drop("cut")
    if sketch.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        sketch = F.broadcast(sketch)
    found = written(own.join(sketch, "hash").filter("m >= need").select("doc_id", "name", "key").distinct(), "leak-candidates")
    pairs = found.join(items.select("key", "item_id", "shingles", "n", "need"), "key")
    names = found.select("name").distinct()
    if names.count() <= BROADCAST_DOCS:
        names = F.broadcast(names)
    # the texts of candidates only, once each
    some = text.select("name", "text").join(names, "name", "left_semi").dropDuplicates(["name"])
    both = pairs.join(some.select("name", F.explode(F.array(words())).alias("w")).select("name", _texts().alias("have")), "name")
    both = both.withColumn("n_shared", F.size(F.array_intersect("shingles", "have")))
    return both.filter(F.col("n_shared") >= F.col("need")).select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"),
        (F.col("n_shared") / F.col("n")).alias("containment"), "name")


def clean(docs: DataFrame, benchmark: DataFrame, at_least: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that contain no item, null texts among them."""
    hit = written(leaks(docs, benchmark, at_least).select("name").distinct(), "leak-names")
    if hit.count() <= BROADCAST_DOCS:
        hit = F.broadcast(hit)
    have = docs.select(F.xxhash64("text").alias("name"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return have.join(hit, "name", "left_anti").select("row.*")


def op7_containment(spark, sf_dir: str) -> DataFrame:
    return leaks(scan(spark, sf_dir), scan(spark, sf_dir, "benchmark")).drop("name")


OP7_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, text, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM d, unnest(range(1, len(w) - 3)) t(i)),
bs AS (SELECT DISTINCT item_id, text, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM b, unnest(range(1, len(w) - 3)) t(i)),
n AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY item_id, text)
SELECT doc_id, bs.item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.item_id = bs.item_id AND n.text = bs.text
GROUP BY doc_id, ds.text, bs.item_id, bs.text HAVING count(*) * 10 >= any_value(n) * 8
"""
