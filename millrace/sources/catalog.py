"""Tables as Parquet below one folder: listing, choosing, scanning, registering."""

from __future__ import annotations

from collections.abc import Iterable
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: child table, its columns, parent table, its columns
REFERENCES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the Parquet tables below ``root``, sorted, on any file system that Hadoop reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def select_tables(names: Iterable[str], include: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Those of ``names``, in their order, that a pattern of ``include`` matches (none: all) and none of
    ``exclude`` does.  A name without wildcards matches itself only."""
    match = lambda n, ps: any(fnmatchcase(n, p) for p in ps)
    return [n for n in names if (include is None or match(n, include)) and not match(n, exclude)]


def import_schema(spark: SparkSession, root: str, prefix: str, names: Iterable[str]) -> list[str]:
    """Registers tables of another root as views ``prefix__name``; returns the views' names."""
    views = []
    for n in names:
        views.append(f"{prefix}__{n}")
        table(spark, root, n).createOrReplaceTempView(views[-1])
    return views


def drop_schema(spark: SparkSession, prefix: str) -> int:
    """Drops the views of ``import_schema``; how many there were."""
    own = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(f"{prefix}__")]
    for n in own:
        spark.catalog.dropTempView(n)
    return len(own)


def counts(tables: dict[str, DataFrame], of: str = "n_rows") -> DataFrame:
    """(table_name, n_rows): one row per table; Parquet answers a count from its footers."""
    each = [df.agg(F.count("*").alias(of)).select(F.lit(name).alias("table_name"), of) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def column_facts(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable) of all columns, from the schemas alone."""
    return [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema.fields]
