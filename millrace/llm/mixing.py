"""Operator 1: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, scan, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEEDS = 32
#: One row per source; beyond this many sources the table is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> adds target: ``share`` of all sizes dealt by weight, no source above
    ``most`` times its size, the excess reshared by weight until none is above.

    Weights repeat over the sources in code-point order, null last.  Resharing ends at a level L
    with target = min(most * size, L * weight); the sources that are capped are the first ones in
    order of most * size / weight, so L comes from running sums.  The windows hold one row per
    source and run with constant memory.  A source of size 0 gets 0; no sources, no rows."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * most)
    by = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*by).rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(after),
        "all": F.sum("source_size").over(all_) * F.lit(float(share)),
    })
    # the level if just the sources before this one were capped; the true one is the first that caps no more
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(all_))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: Column | int) -> Column:
    """A uniform number in [0, 1) from the seed and the id; equal ids draw alike."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, source, size) -> adds source_size, target, rate, seed, copies.

    rate = target / source_size; a document is taken floor(rate) times and once more if its draw is
    below the fraction.  Each of ``seeds`` seeds is a complete Bernoulli draw; each source uses the
    one whose words come nearest to its target, the smallest at a tie.  All of it is sums by source
    with map-side combining, so a hot source costs one row per task and seed.
    Nulls: a null source is a source of its own, a null doc_id draws as an empty id.  Documents
    without words are taken by the same rule and add no words.  Repeated rows and rows of one id draw alike;
    an empty table gives no rows.  Only these three columns are read."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, weights, share, most)
    t = t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    t = t.withColumn("fraction", F.col("rate") - F.floor("rate"))
    t = written(t, "mix-targets").withColumnRenamed("source", "mix_source")
    small = t.count() <= BROADCAST_SOURCES

    def with_targets(d: DataFrame, s: DataFrame) -> DataFrame:
        return d.join(F.broadcast(s) if small else s, d["source"].eqNullSafe(s["mix_source"]), "left").drop("mix_source")

    extra = [F.sum(F.when(draw(F.col("doc_id"), k) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"e{k}") for k in range(seeds)]
    got = with_targets(docs, t).groupBy("source").agg(
        F.first("target").alias("t"), F.first("fraction").alias("f"),
        F.sum(F.floor("rate") * F.col("size")).alias("base"), *extra)
    off = lambda k: F.abs(F.col("base") + F.col(f"e{k}") - F.col("t"))
    best = F.least(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]).getField("seed") if seeds > 1 else F.lit(0)
    chosen = written(got.select(F.col("source").alias("mix_source"), best.alias("seed")), "mix-seeds")
    out = with_targets(with_targets(docs, t), chosen)
    once_more = (draw(F.col("doc_id"), F.col("seed")) < F.col("fraction")).cast("long")
    return out.withColumn("copies", (F.floor("rate") + once_more).cast("long"))


def sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mixture itself: every row of ``documents`` as often as it is taken, with copy = 1, 2, ...

    Any other columns pass through, whatever their names; where ``copy`` is one of them, the number's column is
    called copy_ (or copy__ and so on).  Rows are never joined with each other: the numbers are by
    source and the draw by id, so repeated rows each count and are each taken.  Null texts have no
    words, a null source is a source; an empty table gives no rows.  Texts may be of any length."""
    number = "copy"
    while number in documents.columns:
        number += "_"
    # sizes are worked out over the slim projection; the wide rows meet only the table of sources
    wide = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), "doc_id", "source")
    plan = copies(written(sized(documents), "mix-sizes"), **how)
    plan = plan.select(F.col("source").alias("of"), "rate", "fraction", "seed").dropDuplicates(["of"])
    plan = written(plan, "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    j = wide.join(F.broadcast(plan) if small else plan, wide["source"].eqNullSafe(plan["of"]), "left")
    k = (F.floor("rate") + (draw(F.col("doc_id"), F.col("seed")) < F.col("fraction")).cast("long")).cast("int")
    return j.filter(k > 0).select("row", F.explode(F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).alias("copy")).select("row.*", F.col("copy").alias(number))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = written(sized(scan(spark, sf_dir)), "mix-sizes")
    return copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


_DRAW = "CAST(('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM w),
f AS (SELECT *, (total - CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS lv FROM r),
l AS (SELECT lv AS level FROM f WHERE lv * weight <= cap ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(cap AS DOUBLE))) AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
j AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, floor(q.rate)::BIGINT AS base, q.rate - floor(q.rate) AS fraction
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT j.*, seed, {_DRAW.format(seed="seed")} < fraction AS more FROM j, range({SEEDS}) g(seed)),
o AS (SELECT source, seed, abs(CAST(sum((base + more::INT) * size) AS DOUBLE) - any_value(target)) AS off FROM k GROUP BY source, seed),
b AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM o GROUP BY source)
SELECT k.doc_id, k.size, k.source_size, k.target, (k.base + k.more::INT) * k.size AS taken, k.source, k.base + k.more::INT AS copies
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.seed = b.seed
"""
