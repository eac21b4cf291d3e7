"""Batches, round trips, seeds, checks and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import masking as m
from millrace.functions.registry import Policy, Rule
from millrace.operators import audit, movement as mv, schema
from millrace.plans.base import ORACLES, query
from millrace.plans.checks import _EXPECTED, _LIVE
from millrace.plans.masks import sync_mask_customer
from millrace.session import scratch
from millrace.sources import seeds
from millrace.sources.catalog import table


@query("SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_num, (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1) // 5000 AS batch_id FROM lineitem")
def batches_of_lineitem(spark, d):
    """All columns, by a key that many rows share."""
    return mv.with_batches(table(spark, d, "lineitem"), "l_shipdate", 5000, ["l_orderkey", "l_linenumber"], nulls_first=False).withColumn("row_num", F.col("row_num").cast("long"))


@query("SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_num, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id FROM orders")
def batches_of_orders(spark, d):
    return mv.with_batches(table(spark, d, "orders"), "o_orderkey", 1000, nulls_first=False).withColumn("row_num", F.col("row_num").cast("long"))


@query("SELECT t AS table_name, n AS n_rows, true AS synced, false AS again FROM (SELECT 'customer' AS t, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'region', (SELECT count(*) FROM region))")
def sync_verify_publish(spark, d):
    """Three tables synced with masking: verified, published, entered in the ledger; a second run of the same id
    has nothing to do."""
    s = mv.Sync(spark, d, scratch(spark, "sync"), Policy({"customer": [Rule("c_name", "sync_name")]}))
    first = s.run(["customer", "nation", "region"], run_id="r")
    again = {x.table for x in s.run(["customer", "nation", "region"], run_id="r")}
    return spark.createDataFrame([(x.table, s.read(x.table).count(), x.rows > 0, x.table in again) for x in first], "table_name string, n_rows long, synced boolean, again boolean")


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN 'a \"q\", b' || chr(10) || 'c' ELSE o_orderstatus END AS note, o_orderkey, o_totalprice, o_orderdate FROM orders")
def csv_copy(spark, d):
    k = F.col("o_orderkey") % 7
    note = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, 'a "q", b\nc').otherwise(F.col("o_orderstatus"))
    return mv.csv_round_trip(table(spark, d, "orders").select(note.alias("note"), "o_orderkey", "o_totalprice", "o_orderdate"), scratch(spark, "csv"))


@query("SELECT o_orderkey // 500 AS range, count(*) AS n_rows FROM orders GROUP BY 1")
def range_batches(spark, d):
    """Copied by ranges of keys in two runs: the second finds the first ranges there."""
    o, path = table(spark, d, "orders"), scratch(spark, "ranges")
    mv.range_copy(o.filter("o_orderkey < 1500"), "o_orderkey", 500, path)
    return mv.range_copy(o, "o_orderkey", 500, path).select(F.col("range").cast("long").alias("range"), "n_rows")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 500)")
def limit_batch(spark, d):
    return mv.take_batch(table(spark, d, "orders"), "o_totalprice > 200000", 500, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("WITH p AS (SELECT p_partkey, p_partkey // 3 AS parent, p_partkey * 10 AS pk FROM part WHERE p_partkey % 5 > 0) SELECT a.p_partkey, a.parent, a.pk, b.pk AS fk_parent FROM p a LEFT JOIN p b ON a.parent = b.p_partkey")
def self_reference(spark, d):
    p = table(spark, d, "part").filter("p_partkey % 5 > 0").select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("parent"), (F.col("p_partkey") * 10).alias("pk"))
    return mv.resolve_self(p, "p_partkey", "parent", "pk", "fk_parent")


@query("SELECT p_partkey, i::INT AS pos, string_split(p_name, ' ')[i] AS word FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) t(i)")
def unnest_with_ordinality(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


@query("SELECT n_nationkey, unnest(range(0, n_nationkey::BIGINT + 1, 5)) AS step FROM nation")
def generate_series(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long"), F.lit(5).cast("long"))).alias("step"))


@query("SELECT o_orderkey, CASE WHEN lower(substr(o_orderpriority, 3)) IN ('urgent', 'high', 'medium', 'low') THEN lower(substr(o_orderpriority, 3)) END AS priority, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)")
def cast_enum_and_uuid(spark, d):
    from millrace.functions.text import to_enum, to_uuid

    return table(spark, d, "orders").select(
        "o_orderkey", to_enum(F.lower(F.substr("o_orderpriority", F.lit(3))), ["urgent", "high", "medium", "low"]).alias("priority"), to_uuid(F.md5(F.col("o_orderkey").cast("string"))).alias("id"))


@query(f"SELECT severity, count(*) AS n FROM ({ORACLES['drift_report']}) GROUP BY severity")
def drift_severities(spark, d):
    """How many findings of each severity: a missing and an extra table, a missing and an extra column, a type, a null."""
    of = lambda r: spark.createDataFrame(r, "table_name string, column_name string, type string, nullable boolean")
    return schema.drift(of(_EXPECTED), of(_LIVE)).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def materialized_rollup(spark, d):
    view = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return mv.materialize(view, scratch(spark, "rollup"))


@query("""SELECT 'backfill' AS step, count(*) AS before, count(*) AS after, count(*) FILTER (WHERE value > 50) AS changed, '' AS error FROM events
  UNION ALL SELECT 'delete', count(*), count(*) FILTER (WHERE NOT value > 90), 0, '' FROM events""")
def dry_run_report(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return spark.createDataFrame(mv.dry_run(e, {
        "backfill": lambda x: mv.backfill(x, "event_type", "'very high'", "value > 50"), "delete": lambda x: mv.delete_where(x, "value > 90")}),
        "step string, before long, after long, changed long, error string")


@query("SELECT t AS table_name, n AS n_rows FROM (VALUES ('users', 3::BIGINT), ('tags', 1::BIGINT)) x(t, n)")
def seed_apply(spark, d):
    """Two good files, and one whose second statement is bad: nothing of that one is loaded."""
    root = scratch(spark, "seeds")
    files = {
        "a.sql": "INSERT INTO users (id, name) VALUES (1, 'Ann'), (2, 'Bob');", "bad.sql": "INSERT INTO users (id, name) VALUES (9, 'x'); INSERT INTO tags (id) VALUES (now());",
        "c.sql": "INSERT INTO users (id, name) VALUES (3, NULL); INSERT INTO tags (id) VALUES (7);"}
    seeds.apply_files(spark, files, root, keep_going=True)
    return audit.union_all([spark.read.parquet(f"{root}/{t}.parquet").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in ("users", "tags")])


_CHECKS = {
    "unique:orders": "SELECT count(*) = count(DISTINCT o_orderkey) FROM orders", "unique:lineitem": "SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem",
    "references:orders": "SELECT count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "references:nation": "SELECT count(*) = 0 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')",
    "more:region:4": "SELECT count(*) > 4 FROM region", "more:region:5": "SELECT count(*) > 5 FROM region"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, ({q}) AS ok" for n, q in _CHECKS.items()))
def preconditions(spark, d):
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"pre_{t}")
    table(spark, d, "region").filter("r_name <> 'ASIA'").createOrReplaceTempView("pre_some_region")
    found = audit.run_checks(spark, [
        audit.unique("pre_orders", "o_orderkey"), audit.unique("pre_lineitem", "l_orderkey"), audit.references("pre_orders", "o_custkey", "pre_customer", "c_custkey"),
        audit.references("pre_nation", "n_regionkey", "pre_some_region", "r_regionkey"), audit.row_count_above("pre_region", 4), audit.row_count_above("pre_region", 5)])
    return spark.createDataFrame([(n, ok) for n, (_, ok, _) in zip(_CHECKS, found)], "name string, ok boolean")


_C = "(SELECT c_custkey, c_name, 'user' || c_custkey || '@corp.example' AS email FROM customer)"


@query(f"""WITH c AS (SELECT *, 'user_' || substr(sha256(email), 1, 8) || '@example.com' AS masked FROM {_C})
  SELECT 'email' AS column_name, count(*)::BIGINT AS n_rows, 0::BIGINT AS null_changed, 0::BIGINT AS unchanged, 0::BIGINT AS split,
    (SELECT count(*) FROM (SELECT masked FROM c GROUP BY masked HAVING count(DISTINCT email) > 1)) AS merged FROM c
  UNION ALL SELECT 'c_name', count(*), 0, 0, 0, (SELECT count(*) FROM (SELECT substr(sha256(c_name), 1, 2) AS x FROM c GROUP BY 1 HAVING count(DISTINCT c_name) > 1)) FROM c""")
def masking_validation(spark, d):
    c = table(spark, d, "customer").select("c_name", F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@corp.example")).alias("email"))
    c = c.select("*", m.sync_email(F.col("email")).alias("e"), F.substring(F.sha2("c_name", 256), 1, 2).alias("n"))
    return m.masking_quality(c, {"email": "e", "c_name": "n"})


_FORMS = {"c_name": "^User [0-9A-F]{4}$", "email": "^user_[0-9a-f]{8}@example[.]com$", "phone": "^[+]1-555-[0-9]{4}$"}
_MASKED = """(SELECT 'User ' || upper(substr(sha256(c_name), 1, 4)) AS c_name, 'user_' || substr(sha256(c_name), 1, 8) || '@example.com' AS email,
  '+1-555-' || CAST(CAST(('0x' || substr(sha256(c_name), 1, 8)) AS BIGINT) % 10000 AS VARCHAR) AS phone FROM customer)"""
_REPORT = [*[(f"masked:{c}", f"SELECT count({c}) AS total, count(*) FILTER (WHERE NOT regexp_matches({c}, '{p}')) AS violations FROM {_MASKED}") for c, p in _FORMS.items()],
           *[(f"references:{c}", f"SELECT count({k}) AS total, count(*) FILTER (WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {pk} = {k})) AS violations FROM {c}")
             for c, k, p, pk in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey"))],
           ("text:ssn", "SELECT count(text) AS total, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) AS violations FROM documents"),
           ("text:email", "SELECT count(text) AS total, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.]')) AS violations FROM documents"),
           ("not_null:o_custkey", "SELECT count(*) AS total, count(*) - count(o_custkey) AS violations FROM orders"),
           ("duplicates:l_orderkey", "SELECT count(*) AS total, count(*) - count(DISTINCT l_orderkey) AS violations FROM lineitem")]


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, total, violations FROM ({q})" for n, q in _REPORT)
       + ") SELECT *, CASE WHEN violations = 0 THEN 'PASS' WHEN check_name LIKE 'text:%' AND violations * 20 <= total THEN 'WARN' ELSE 'FAIL' END AS status FROM r")
def verification_report(spark, d):
    """Ten checks of a masked copy, each table read once: forms of masked columns, references, personal data in text,
    nulls and duplicates."""
    masked = audit.mask_report(sync_mask_customer(spark, d), _FORMS).select(F.concat(F.lit("masked:"), "column_name").alias("check_name"), "total", "violations")
    refs = [audit.fk_audit(table(spark, d, c), k, table(spark, d, p), pk, f"references:{c}").select(F.col("reference").alias("check_name"), "total", "violations")
            for c, k, p, pk in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey"))]
    found = {"text:ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "text:email": "[A-Za-z0-9._]+@[A-Za-z0-9]+[.]"}
    text = table(spark, d, "documents").agg(F.count("text").alias("total"), *[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in found.items()])
    text = text.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col("total"), F.col(n).alias("violations")) for n in found])))
    nulls = table(spark, d, "orders").agg(F.lit("not_null:o_custkey").alias("check_name"), F.count("*").alias("total"), F.count_if(F.col("o_custkey").isNull()).alias("violations"))
    dup = table(spark, d, "lineitem").agg(F.lit("duplicates:l_orderkey").alias("check_name"), F.count("*").alias("total"), (F.count("*") - F.countDistinct("l_orderkey")).alias("violations"))
    r = audit.union_all([masked, *refs, text, nulls, dup])
    status = F.when(F.col("violations") == 0, "PASS").when(F.col("check_name").startswith("text:") & (F.col("violations") * 20 <= F.col("total")), "WARN").otherwise("FAIL")
    return r.withColumn("status", status)
