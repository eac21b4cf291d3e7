"""Operator 2: quality rules as a bitmask ledger.  DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, scan

WINDOW = 5

#: Bit -> (rule, SQL over the measurements that is true where the rule fails).  A bit never changes its
#: meaning; new rules take new bits.
RULES = {
    0: ("few_words", "n_words < 10"),
    1: ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    2: ("symbols", "10 * n_symbols > 3 * n_words"),
    3: ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    4: ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    5: ("capitals", "2 * n_upper > n_upper + n_lower AND n_upper >= 20"),
}
BASE = 0b11
#: Version -> the bits that reject a document.
POLICIES = {1: BASE, 2: BASE | 0b1100, 3: BASE | 0b111100}
POLICY = 3

_WORDS = f"array_remove(split(coalesce(text, ''), '[{BLANKS}]+'), '')".replace("\\", "\\\\")
_LINES = f"filter(split(coalesce(text, ''), '\\\\n'), x -> x rlike '[^{BLANKS}]')".replace("[^\\x20\\x09-\\x0D]", "[^\\\\x20\\\\x09-\\\\x0D]")

#: Windows that occur once are most of a text: only where distinct windows are fewer is the sorted
#: form made.  Sorting (hash, place) puts equal windows side by side; their places, in order, cover
#: min(5, distance to the next) words each.
_PLACES = """
transform(array(array_sort(transform(__windows, (x, i) -> struct(x, i)))), s ->
  sort_array(filter(transform(s, (e, k) ->
    CASE WHEN (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x)
         THEN e.i ELSE -1 END), p -> p >= 0)))[0]"""
_COVERED = f"""
CASE WHEN size(__windows) < 2 OR size(array_distinct(__windows)) = size(__windows) THEN 0L
     ELSE aggregate(transform(array({_PLACES}), p ->
       transform(p, (x, k) -> CASE WHEN k < size(p) - 1 THEN least({WINDOW}, p[least(k + 1, size(p) - 1)] - x) ELSE {WINDOW} END))[0],
       0L, (a, x) -> a + x) END"""


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements; columns of these names in ``docs`` are replaced.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with
    a word that equal an earlier line), n_lines (lines with a word), n_repeat_words (words in five-word windows
    that the text has twice or more; windows are compared by 64-bit hashes within one text),
    n_upper, n_lower.  A null text measures as an empty one: all zero.  Everything stays within the
    row: no shuffle, and a very long text costs n log n.  Repeated rows repeat; no rows, no rows."""
    keep = [c for c in docs.columns if c not in _MEASURES]
    w = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.expr(_WORDS).alias("__w"), F.expr(_LINES).alias("__l"))
    # sequence() would count down for short texts
    h = f"""CASE WHEN size(__w) < {WINDOW} THEN cast(array() as array<bigint>)
            ELSE transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({", ".join(f"__w[i + {k}]" for k in range(WINDOW))})) END"""
    w = w.withColumn("__windows", F.expr(h))
    return w.select(
        "row.*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.expr(_COVERED).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("\\p{Ll}")).cast("long").alias("n_lower"),
    )


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_lower")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements and ``fail_bits``: every rule evaluated once, its bit set if it fails.

    The bits come out of a generator: a policy's filter can't be pushed below it, where each of its
    mentions of a measurement would be worked out anew.  A column ``fail_bits`` of ``docs`` is replaced."""
    bits = [f"IF({sql}, {1 << b}L, 0L)" for b, (_, sql) in RULES.items()]
    return measured(docs.drop("fail_bits")).select("*", F.explode(F.array(F.expr(" | ".join(bits)))).alias("fail_bits"))


def rejected(fail_bits: Column, policy: int = POLICY) -> Column:
    return fail_bits.bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(book: DataFrame, policy: int = POLICY) -> DataFrame:
    """The rows of a ledger that a policy version keeps; the ledger itself isn't recomputed."""
    return book.filter(~rejected(F.col("fail_bits"), policy))


def ablations(book: DataFrame, policy: int = POLICY) -> DataFrame:
    """One row per rule of the policy: how many documents fail it, fail it alone, and go if it is left out.

    One pass of bitwise aggregation: the ledger is first counted by pattern of bits (at most
    2^rules rows), the rest works on those."""
    mask = POLICIES[policy]
    p = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule")) for b, (name, _) in RULES.items() if mask >> b & 1]))
    p = p.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    one = F.expr("shiftleft(1L, bit)")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return p.groupBy("bit", "rule").agg(
        total(F.col("bits").bitwiseAND(one) != 0).alias("n_failed"),
        total(F.col("bits") == one).alias("n_failed_alone"),
        total((F.col("bits") != 0) & (F.col("bits") != one)).alias("n_rejected_without"),
    )


def quality_filter(docs: DataFrame, policy: int = POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return apply_policy(ledger(packed), policy).select("__row.*")


def op2_quality_ledger(spark, sf_dir: str) -> DataFrame:
    book = ledger(scan(spark, sf_dir).select("doc_id", "text"))
    base = rejected(F.col("fail_bits"), 1)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~rejected(F.col("fail_bits"))).alias("kept"), "fail_bits")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(text, '\p{Ll}'))::BIGINT AS n_lower
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        | CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END | CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        | CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
        | CASE WHEN 2 * n_upper > n_upper + n_lower AND n_upper >= 20 THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
