"""Movement, rewrite, join and aggregate queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import movement as mv
from millrace.plans.base import query
from millrace.session import scratch
from millrace.sources.catalog import TABLES, list_tables, select_tables, table
from millrace.sources.seeds import copy_lines
from millrace.streaming import masked_increment


@query("SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total FROM orders")
def colmap_migrate_orders(spark, d):
    return mv.remap(table(spark, d, "orders"), {"o_orderkey": "id", "o_custkey": "customer_id", "o_orderstatus": "status", "o_totalprice": "total"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS l_extendedprice, lower(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity > 25 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def copy_with_transform(spark, d):
    return mv.copy_rows(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"],
        {"l_extendedprice": "l_extendedprice * (1 - l_discount)", "l_returnflag": "lower(l_returnflag)"}, "l_quantity > 25 AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'")


@query("SELECT * FROM orders")
def raw_copy(spark, d):
    """Every row of orders, written to another root and read from there."""
    return mv.materialize(table(spark, d, "orders"), scratch(spark, "raw-copy"))


@query("SELECT batch_id, count(*) AS n_rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id FROM orders) GROUP BY batch_id")
def batch_tracker(spark, d):
    b = mv.with_batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, nulls_first=False)
    return b.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query(" UNION ALL ".join(f"SELECT {x}::INT AS above, coalesce(min(o_orderkey), 0) AS low, coalesce(max(o_orderkey), 0) AS high FROM orders WHERE o_totalprice > {x}" for x in (0, 300000, 2000000000)))
def batch_bounds(spark, d):
    """Bounds of all orders, of dear ones and of none."""
    o = table(spark, d, "orders")
    dear = lambda f, x: F.coalesce(f(F.when(F.col("o_totalprice") > x, F.col("o_orderkey"))), F.lit(0))
    return o.agg(F.array(*[F.struct(F.lit(x).alias("above"), dear(F.min, x).alias("low"), dear(F.max, x).alias("high")) for x in (0, 300000, 2000000000)]).alias("r")).select(F.inline("r"))


@query("SELECT event_id, CASE WHEN nullif(value, 50) > 50 THEN 'high' ELSE event_type END AS event_type FROM events")
def backfill_column(spark, d):
    return mv.backfill(table(spark, d, "events"), "event_type", "'high'", "nullif(value, 50) > 50").select("event_id", "event_type")


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'n/a') AS event_type, 1 AS version FROM events")
def add_column_default(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    return mv.add_column(mv.add_column(e, "event_type", "'n/a'"), "version", "1")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '5-LOW') < '3', false)")
def delete_where(spark, d):
    return mv.delete_where(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "nullif(o_orderpriority, '5-LOW') < '3'")


_OLD, _NEW = "o_orderkey % 3 > 0", "o_orderkey % 2 = 0"


def _sides(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.filter(_OLD), o.filter(_NEW).withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderstatus", F.lit("N"))


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_OLD}), b AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE {_NEW})
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def upsert_do_update(spark, d):
    return mv.upsert(*_sides(spark, d), ["o_orderkey"], ["o_totalprice"])


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_OLD}), b AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE {_NEW})
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)""")
def upsert_do_nothing(spark, d):
    return mv.insert_missing(*_sides(spark, d), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def update_from_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("segment"))
    return mv.update_from(o, table(spark, d, "customer").filter("c_acctbal > 0"), ("o_custkey", "c_custkey"), {"segment": "c_mktsegment"})


@query("WITH r AS (SELECT r_name, row_number() OVER (ORDER BY r_name)::INT AS pk_region FROM region), n AS (SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, n_name, CASE WHEN r.r_name <> 'ASIA' THEN pk_region END AS fk_region FROM n LEFT JOIN r ON region = r_name")
def fk_resolution(spark, d):
    region = table(spark, d, "region")
    final = region.select("r_name", F.row_number().over(Window.orderBy("r_name")).alias("pk_region")).filter("r_name <> 'ASIA'")
    staged = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("region"))
    return mv.resolve_keys(staged, final, ("region", "r_name"), "pk_region", "fk_region")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 3")
def agg_category_topk(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    a = g.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"))
    return a.orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(3)


@query("SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
def agg_having_view(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey")
    a = g.agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("t"), F.countDistinct("o_orderstatus").alias("n_status")).filter("t > 1000000")
    return a.select("o_custkey", "n_orders", F.round("t", 2).alias("total"), "n_status")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_rollup(spark, d):
    # orders are combined before the join: one row per customer meets it
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"), F.max("o_orderdate").alias("last_order"))
    j = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"), "last_order")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
def sample_by_hash(spark, d):
    return table(spark, d, "orders").orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderkey").limit(1000).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE a.o_totalprice = b.o_totalprice) AS n_equal, round(100.0 * count(*) FILTER (WHERE a.o_totalprice = b.o_totalprice) / nullif(count(*), 0), 2)::DOUBLE AS accuracy FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders) b USING (o_orderkey)")
def fidelity_check(spark, d):
    from millrace.operators.audit import percentage

    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    b = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("y"))
    r = a.join(b, "o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("n_equal"))
    return r.withColumn("accuracy", percentage(F.col("n_equal"), F.col("n")).cast("double"))


def _copy_sql(cols):
    esc = lambda c: f"replace(replace(replace(replace(CAST({c} AS VARCHAR), chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
    return " || chr(9) || ".join(f"coalesce({esc(c)}, chr(92) || 'N')" for c in cols)


@query(f"SELECT {_copy_sql(['doc_id', 'text', 'lang', chr(39) + 'a' + chr(39) + '||chr(92)||' + chr(39) + 'b' + chr(39), 'NULL'])} AS line FROM documents")
def copy_text_rows(spark, d):
    return copy_lines(table(spark, d, "documents").select("doc_id", "text", "lang", F.lit("a\\b").alias("x"), F.lit(None).cast("string").alias("y")))


@query("SELECT year(ts)::INT AS y, month(ts)::INT AS m, count(*) AS n FROM events GROUP BY ALL")
def partition_by_month(spark, d):
    path = scratch(spark, "by-month")
    e = table(spark, d, "events").withColumn("y", F.year("ts")).withColumn("m", F.month("ts"))
    e.write.mode("overwrite").partitionBy("y", "m").parquet(path)
    return spark.read.parquet(path).groupBy("y", "m").agg(F.count("*").alias("n"))


@query("SELECT t AS table_name FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") x(t) WHERE (t LIKE 'o%' OR t IN ('customer', 'supplier')) AND t NOT LIKE 'supp%'")
def select_tables_q(spark, d):
    names = select_tables(list_tables(spark, d), ["customer", "o*", "supplier"], ["supp*"])
    return spark.createDataFrame([(n,) for n in names], "table_name string")


@query("SELECT count(*) AS n, count(DISTINCT user_hash) AS n_users FROM (SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS user_hash FROM events)")
def incremental_events(spark, d):
    """A stream over the events' files, masked, run twice: the second run finds nothing new."""
    from millrace.functions.registry import Policy, Rule

    base = scratch(spark, "increment")
    table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("string")).write.parquet(f"{base}/in")
    policy = Policy({"events": [Rule("user_id", "sync_hash")]})
    for _ in range(2):
        masked_increment(spark, f"{base}/in", f"{base}/out", f"{base}/state", policy, "events")
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION SELECT r_name, 'region' FROM region")
def union_distinct(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))).distinct()
