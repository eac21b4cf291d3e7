"""Migration ledger, checksums, risk, rollback and step debugging: small data, on the driver or as tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.schema import statements, without_comments

TIERS = {"safe": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
_RISKS = (
    (r"^drop\s+(table|schema|database)|^truncate", "critical"),
    (r"^alter\s+table\b.*\bdrop\s+column|^delete\s+from\s+\S+\s*$", "critical"),
    (r"^alter\s+table\b.*\b(alter\s+column\b.*\btype|rename)\b", "high"),
    (r"^update\b(?!.*\bwhere\b)|^alter\s+table\b.*\bset\s+not\s+null", "high"),
    (r"^(update|delete)\b|^alter\s+table\b.*\badd\s+constraint|^drop\s+(index|view|function)", "medium"),
    (r"^alter\s+table\b.*\badd\s+(column\s+)?|^create\s+(unique\s+)?index", "low"),
    (r"^(create|insert|comment|select|grant|with)\b", "safe"),
)


def risk(statement: str) -> str | None:
    """The tier of a statement, None if it is of no known kind."""
    s = " ".join(without_comments(statement).split()).lower()
    return next((tier for p, tier in _RISKS if re.search(p, s)), None)


def change_set(sql: str) -> list[dict]:
    return [{"n": i, "statement": s, "tier": risk(s)} for i, s in enumerate(statements(sql), 1)]


def worst_tier(changes: DataFrame, by: list[str] = []) -> DataFrame:
    """The highest tier per group; unclassified ones don't count, and a group of those only has none."""
    rank = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (v, k)])
    return changes.withColumn("__r", F.try_element_at(rank, F.col("tier"))).groupBy(*by).agg(F.max("__r").alias("__m")).select(*by, F.try_element_at(name, F.col("__m")).alias("worst_tier"))


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions that exist and aren't applied, in order."""
    return files.join(applied.select("version"), "version", "left_anti").orderBy("version")


def up_to(files: DataFrame, applied: DataFrame, target: str | None = None) -> DataFrame:
    p = pending(files, applied)
    return p if target is None else p.filter(F.col("version") <= target)


def rollback_plan(applied: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """(step, version, name, can_roll_back): applied versions above the target, newest first."""
    above = applied.filter(F.col("version") > target).select("version", "name")
    downs = files.filter("has_down").select("version", F.lit(True).alias("__d"))
    w = Window.orderBy(F.desc("version"))  # one row per migration
    out = above.join(downs, "version", "left").select("version", "name", F.coalesce("__d", F.lit(False)).alias("can_roll_back"))
    return out.select(F.row_number().over(w).alias("step"), "version", "name", "can_roll_back")


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def verify_checksums(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(version, kind): applied versions whose file is missing or has another checksum."""
    j = applied.select("version", F.col("checksum").alias("a")).join(files.select("version", F.col("checksum").alias("f")), "version", "left")
    kind = F.when(F.col("f").isNull(), "missing_file").when(F.col("a") != F.col("f"), "changed")
    return j.select("version", kind.alias("kind")).filter("kind is not null")


def baseline_rows(ledger: DataFrame, through: str) -> DataFrame:
    return ledger.filter(F.col("version") <= through)


def inverse(statement: str) -> tuple[str | None, str]:
    """(rollback statement or None, note) of a statement."""
    s = " ".join(without_comments(statement).split()).rstrip(";")
    rules = (
        (r"create table (?:if not exists )?(\S+)", r"DROP TABLE \1"), (r"create (?:unique )?index (?:concurrently )?(?:if not exists )?(\S+)", r"DROP INDEX \1"),
        (r"create (?:or replace )?view (\S+)", r"DROP VIEW \1"), (r"create sequence (\S+)", r"DROP SEQUENCE \1"), (r"create type (\S+)", r"DROP TYPE \1"),
        (r"create schema (?:if not exists )?(\S+)", r"DROP SCHEMA \1"), (r"create (?:or replace )?function ([^ (]+)", r"DROP FUNCTION \1"),
        (r"alter table (\S+) add column (?:if not exists )?(\S+)", r"ALTER TABLE \1 DROP COLUMN \2"),
        (r"alter table (\S+) add constraint (\S+)", r"ALTER TABLE \1 DROP CONSTRAINT \2"),
        (r"alter table (\S+) rename column (\S+) to (\S+)", r"ALTER TABLE \1 RENAME COLUMN \3 TO \2"),
        (r"alter table (\S+) rename to (\S+)", r"ALTER TABLE \2 RENAME TO \1"),
        (r"alter table (\S+) alter column (\S+) set not null", r"ALTER TABLE \1 ALTER COLUMN \2 DROP NOT NULL"),
    )
    for p, form in rules:
        if m := re.match(p, s, re.I):
            return m.expand(form).split("(")[0].strip(), ""
    if re.match(r"drop|truncate|delete|update", s, re.I) or re.search(r"drop column", s, re.I):
        return None, "destroys data: copy it first"
    return None, "no known inverse"


def conflict_kind(name: Column) -> Column:
    """What two intents share: objects are written ``function:f``, ``view:v``, ``index:i``, ``table.column`` or ``table``."""
    kind = F.regexp_extract(name, "^(function|view|index):", 1)
    return F.when(kind != "", F.concat(F.lit("same_"), kind)).when(F.instr(name, ".") > 0, "same_column").otherwise("same_table")


def conflicts(intents: DataFrame) -> DataFrame:
    """(a, b, objects): pairs of intents (id, agent, objects array) of different agents that touch the same object.

    Joined on the object, not all with all."""
    o = intents.select("id", "agent", F.explode(F.array_distinct("objects")).alias("object"))
    j = o.alias("x").join(o.alias("y"), (F.col("x.object") == F.col("y.object")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.agent") != F.col("y.agent")))
    return j.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.array_sort(F.collect_set("x.object")).alias("objects"))


def view_closure(spark: SparkSession, edges: DataFrame, start: list[str]) -> DataFrame:
    """(name, depth): everything that depends on ``start`` through (parent, child) edges, at its greatest depth.

    Level by level over distinct names, so paths aren't walked one by one; a cycle is an error."""
    below: dict[str, set] = {}
    for r in edges.select("parent", "child").distinct().collect():  # a catalog's views
        below.setdefault(r["parent"], set()).add(r["child"])
    depth, level, k = {}, set(start), 0
    while level := {c for p in level for c in below.get(p, ())}:
        k += 1
        if k > len(below) + 1:
            raise ValueError(f"the views depend on each other: {sorted(level)}")
        depth.update(dict.fromkeys(level, k))
    return spark.createDataFrame(sorted(depth.items()), "name string, depth int")


class Views:
    """Saves definitions of temporary views (name -> SQL, and the views that each one reads), drops those that
    depend on a table, dependents first, and makes them again in the order that they need."""

    def __init__(self, spark: SparkSession, sql: dict[str, str], reads: dict[str, list[str]]):
        self.spark, self.sql, self.reads = spark, sql, reads
        self.saved: list[str] = []

    def drop(self, changed: str) -> list[str]:
        edges = self.spark.createDataFrame([(p, c) for c, ps in self.reads.items() for p in ps], "parent string, child string")
        order = sorted(view_closure(self.spark, edges, [changed]).collect(), key=lambda r: (-r["depth"], r["name"]))
        self.saved = [r["name"] for r in order]
        for n in self.saved:
            self.spark.catalog.dropTempView(n)
        return self.saved

    def recreate(self) -> list[str]:
        again = self.saved[::-1]
        for n in again:
            self.spark.sql(self.sql[n]).createOrReplaceTempView(n)
        self.saved = []
        return again


def ctes(sql: str) -> tuple[list[tuple[str, str]], str]:
    """([(name, body)], main query) of a WITH statement, by balanced parentheses."""
    m = re.match(r"\s*with\s+(?:recursive\s+)?", sql, re.I)
    if not m:
        return [], sql
    i, found = m.end(), []
    while True:
        n = re.compile(r"\s*(\w+)\s*(?:\([^)]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\(", re.I).match(sql, i)
        if not n:
            break
        depth, j, quoted = 1, n.end(), ""
        while j < len(sql) and depth:
            c = sql[j]
            if quoted:
                quoted = "" if c == quoted else quoted
            elif c in "'\"":
                quoted = c
            else:
                depth += (c == "(") - (c == ")")
            j += 1
        if depth:
            raise ValueError(f"unbalanced parentheses in {n[1]}")
        found.append((n[1], sql[n.end() : j - 1].strip()))
        comma = re.compile(r"\s*,").match(sql, j)
        i = comma.end() if comma else j
        if not comma:
            break
    return found, sql[i:].strip()


def debug_ctes(spark: SparkSession, sql: str, preview: int = 100) -> list[dict]:
    """Runs each step with those before it: (step, name, n_rows, rows or error); stops at the first error."""
    steps, main = ctes(sql)
    out = []
    for k, (name, _) in enumerate([*steps, ("(main)", main)], 1):
        before = ", ".join(f"{n} AS ({b})" for n, b in steps[:k])
        q = f"WITH {before} SELECT * FROM {name}" if k <= len(steps) else (f"WITH {before} {main}" if steps else main)
        try:
            df = spark.sql(q)
            out.append({"step": k, "name": name, "n_rows": df.count(), "rows": df.limit(preview).collect(), "error": None})
        except Exception as e:  # the step's error is its result
            out.append({"step": k, "name": name, "n_rows": None, "rows": [], "error": str(e).splitlines()[0]})
            break
    return out
