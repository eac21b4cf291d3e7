"""Moving and rewriting tables: copy with masking and resume, column maps, backfills, deletes, upserts.

A rewrite is a set expression over the whole table, not a loop of batches: the engine does the
batching.  A published table is a folder that was written and verified under another name first."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.registry import Policy
from millrace.sources.catalog import list_tables, select_tables, table


def remap(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source column -> target column; what isn't mapped is dropped."""
    if not mapping:
        raise ValueError("a column map can't be empty")
    return df.select(*[F.col(s).alias(d) for s, d in mapping.items()])


def copy_rows(df: DataFrame, columns: list[str] | None = None, transform: dict[str, str] = {}, where: str = "TRUE") -> DataFrame:
    """Rows that meet ``where`` (over source columns, so it reaches the scan), columns by expression or as they are."""
    return df.filter(where).select(*[F.expr(transform.get(c, f"`{c}`")).alias(c) for c in columns or df.columns])


def backfill(df: DataFrame, column: str, expression: str, where: str = "TRUE") -> DataFrame:
    """``column`` becomes the expression where the predicate is true; false and null leave it."""
    new = F.when(F.expr(where), F.expr(expression)).otherwise(F.col(column)).alias(column)
    return df.select(*[new if c == column else F.col(c) for c in df.columns])


def add_column(df: DataFrame, column: str, default: str) -> DataFrame:
    """The column, null filled from the default expression; a new one holds the default."""
    if column in df.columns:
        return backfill(df, column, default, f"`{column}` IS NULL")
    return df.select("*", F.expr(default).alias(column))


def delete_where(df: DataFrame, where: str) -> DataFrame:
    """Rows for which the predicate is false or null stay."""
    return df.filter(~F.coalesce(F.expr(where), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Insert or update on ``keys``: matched rows take the ``update`` columns (default: all others) of the new
    row and keep the rest.  Keys are unique on either side; null keys match nothing."""
    update = [c for c in old.columns if c not in keys] if update is None else update
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    j = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full_outer")
    both, only_new = F.col("n.__n").isNotNull(), F.col("o.__o").isNull()
    pick = lambda c: F.when(only_new | (both & F.lit(c in update)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(*[pick(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, leaving rows that exist; of new rows with one key the least by its other columns."""
    rest = [c for c in old.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*rest or keys)
    first = new.select(*old.columns).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def update_from(df: DataFrame, other: DataFrame, on: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    """Columns of the matching row of ``other`` (unique on its key), target -> source; unmatched rows keep theirs."""
    left, right = on
    o = other.select(F.col(right).alias("__key"), *[F.col(s).alias(f"__{t}") for t, s in columns.items()])
    j = df.join(o, F.col(left) == F.col("__key"), "left")
    new = lambda c: F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)).alias(c)
    return j.select(*[new(c) if c in columns else F.col(c) for c in [*df.columns, *[c for c in columns if c not in df.columns]]])


def resolve_keys(staged: DataFrame, final: DataFrame, natural: tuple[str, str], surrogate: str, as_: str) -> DataFrame:
    """Replaces a natural reference by the surrogate key of the final table; null where none matches."""
    child, parent = natural
    p = final.select(F.col(parent).alias("__natural"), F.col(surrogate).alias(as_))
    return staged.join(p, F.col(child) == F.col("__natural"), "left").drop("__natural", child)


CUTS = 256  # ranges in which rows are numbered, at most
SAMPLED = 20_000  # keys that the cut points are taken from


def cut_points(df: DataFrame, key: str, ranges: int) -> list:
    """Up to ``ranges`` - 1 increasing keys that cut the rows in about equal parts, from a bounded sample."""
    sample = sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).orderBy(F.rand(7)).limit(SAMPLED).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def sortable(kind: T.DataType) -> bool:
    """Whether rows can be ordered by a type: not by maps, variants and calendar intervals, nor by what holds them."""
    if isinstance(kind, T.ArrayType):
        return sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def with_batches(df: DataFrame, key: str, size: int, ties: list[str] = [], ranges: int | None = None, nulls_first: bool = True) -> DataFrame:
    """``row_num`` by key, then ``ties``, then the other columns in their order, and ``batch_id`` of consecutive runs
    of ``size`` rows.  Nulls come first in each, or last as in the SQL of the queries.

    The row number is global, but no task sorts all rows: a row's range is a function of its key, rows are
    numbered within their range and shifted by the sizes of the ranges before it, a broadcast of ``ranges``
    numbers.  Rows are shuffled once.  A row's number depends on the rows alone, not on files, partitions or
    the order they arrive in, so a batch that is made again holds the same rows; only rows that differ in nothing
    but types without an order (see ``sortable``) are numbered in any order."""
    spark = df.sparkSession
    n = min(CUTS, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[key].dataType
    cuts = F.lit(0)
    for c in cut_points(df, key, n):
        cuts = cuts + F.coalesce((F.col(key) >= F.lit(c).cast(kind)).cast("int"), F.lit(0 if nulls_first else 1))
    own = df.withColumn("__part", cuts)
    per = own.groupBy("__part").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    ordered = lambda c: F.asc_nulls_first(c) if nulls_first else F.asc_nulls_last(c)
    rest = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema if f.name not in (key, *ties) and sortable(f.dataType)]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*map(ordered, (key, *ties, *rest))))
    out = own.withColumn("__rn", rank).join(F.broadcast(shift), "__part", "left")
    return out.withColumn("row_num", F.col("__rn") + F.col("__before")).withColumn("batch_id", F.floor((F.col("row_num") - 1) / size)).drop("__part", "__rn", "__before")


def take_batch(df: DataFrame, where: str, n: int, key: str) -> DataFrame:
    """The whole rows of the first ``n`` keys, in order of key, among rows that meet ``where``: ids are chosen
    alone and the rows fetched by a semi-join."""
    ids = df.filter(where).select(key).orderBy(key).limit(n)
    return df.join(F.broadcast(ids), key, "left_semi")


def range_copy(df: DataFrame, key: str, size: int, path: str) -> DataFrame:
    """Copies rows in ranges of ``size`` values of an integer key, each range a folder of ``path``; ranges that
    are there already stay as they are, so a run that broke off goes on.  Returns (range, n_rows) of all."""
    spark = df.sparkSession
    own = df.withColumn("range", F.floor(F.col(key) / size))
    try:
        done = spark.read.parquet(path).select("range").distinct()
        own = own.join(F.broadcast(done), "range", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    own.repartition("range").write.mode("append").partitionBy("range").parquet(path)
    return spark.read.parquet(path).groupBy("range").agg(F.count("*").alias("n_rows"))


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Writes CSV and reads it back with the same schema: nulls, empty texts, quotes and line feeds are kept."""
    form = {"nullValue": "\\N", "emptyValue": '""', "quote": '"', "escape": '"', "multiLine": "true", "header": "true"}
    df.write.mode("overwrite").options(**form).csv(path)
    form["emptyValue"] = ""
    return df.sparkSession.read.schema(df.schema).options(**form).csv(path)


def resolve_self(df: DataFrame, key: str, parent: str, surrogate: str, as_: str) -> DataFrame:
    """Two passes over a self-reference: rows first get their surrogates, then references to their own table
    are looked up among them; null where none matches."""
    up = df.select(F.col(key).alias("__key"), F.col(surrogate).alias(as_))
    return df.join(up, F.col(parent) == F.col("__key"), "left").drop("__key")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """A view's rows, written: later reads don't work them out again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def dry_run(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> list[tuple[str, int, int, int, str]]:
    """(step, rows before, rows after, rows that are new or different, error) of rewrites in order, without
    writing anything; it stops at the first error."""
    out = []
    for name, step in steps.items():
        before = df.count()
        try:
            new = step(df)
            out.append((name, before, new.count(), new.exceptAll(df).count() if new.columns == df.columns else new.count(), ""))
        except Exception as e:  # the step's error is its result
            out.append((name, before, 0, 0, str(e).splitlines()[0]))
            break
        df = new
    return out


@dataclass
class Metrics:
    table: str
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0


class Ledger:
    """An append-only Parquet table of what has been published: (run, table_name, rows, path, at)."""

    SCHEMA = "run string, table_name string, rows long, path string, at double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, run: str, name: str, rows: int, path: str) -> None:
        self.spark.createDataFrame([(run, name, rows, path, time.time())], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def done(self, run: str) -> set[str]:
        return {r[0] for r in self.read().filter(F.col("run") == run).select("table_name").distinct().collect()}


@dataclass
class Sync:
    """Copies tables from one root to another, masking by policy; each is verified, then published, then
    entered in the ledger, so an interrupted run resumes after the last table that it finished.

    A target is ``root/name.parquet/v-<id>`` with the current one named in ``root/name.parquet/CURRENT``;
    replacing that small file is the only step that must be atomic, and on object stores it is."""

    spark: SparkSession
    source: str
    target: str
    policy: Policy = field(default_factory=lambda: Policy({}))

    def tables(self, include=None, exclude=()) -> list[str]:
        return select_tables(list_tables(self.spark, self.source), include, exclude)

    def one(self, name: str) -> Metrics:
        began = time.time()
        df = table(self.spark, self.source, name)
        masked = self.policy.apply(name, df)
        path = f"{self.target}/{name}.parquet/v-{uuid.uuid4().hex}"
        masked.write.parquet(path)
        want, got = df.count(), self.spark.read.parquet(path).count()
        if want != got:
            self._fs(path)[0].delete(self._fs(path)[1], True)
            raise ValueError(f"{name}: {got} rows were written, {want} read; not published")
        self._publish(name, path)
        return Metrics(name, got, time.time() - began)

    def run(self, include=None, exclude=(), run_id: str | None = None, ledger: Ledger | None = None) -> list[Metrics]:
        ledger = ledger or Ledger(self.spark, f"{self.target}/_ledger")
        run_id = run_id or uuid.uuid4().hex
        done, out = ledger.done(run_id), []
        for name in self.tables(include, exclude):
            if name not in done:
                m = self.one(name)
                ledger.append(run_id, name, m.rows, self.current(name))
                out.append(m)
        return out

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _publish(self, name: str, path: str) -> None:
        fs, p = self._fs(f"{self.target}/{name}.parquet/_CURRENT")
        out = fs.create(p, True)
        out.write(bytearray(path.encode()))
        out.close()

    def current(self, name: str) -> str:
        fs, p = self._fs(f"{self.target}/{name}.parquet/_CURRENT")
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current(name))


def migrate(source: DataFrame, mapping: dict[str, str], path: str) -> int:
    """Writes the remapped rows and returns how many were moved (not what the target holds in all)."""
    out = remap(source, mapping)
    before = _count(source.sparkSession, path)
    out.write.mode("append").parquet(path)
    return _count(source.sparkSession, path) - before


def _count(spark, path) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


