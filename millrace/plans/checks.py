"""Audit and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.masking import PATTERNS
from millrace.operators import audit, control, schema
from millrace.plans.base import query
from millrace.plans.masks import sync_mask_customer
from millrace.sources.catalog import KEYS, REFERENCES, TABLES, column_facts, counts, table

_AUDITED = ["email", "phone_us", "ssn", "credit_card", "ipv4"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '{PATTERNS[p]}')) AS n_rows FROM documents" for p in _AUDITED))
def audit_pii_patterns(spark, d):
    return audit.pii_audit(table(spark, d, "documents"), "text", _AUDITED)


_FORMS = {"c_name": "^User [0-9A-F]{4}$", "email": "^user_[0-9a-f]{8}@example[.]com$", "phone": "^[+]1-555-[0-9]{4}$"}
_MASKED = """SELECT 'User ' || upper(substr(sha256(c_name), 1, 4)) AS c_name, 'user_' || substr(sha256(c_name), 1, 8) || '@example.com' AS email,
  '+1-555-' || CAST(CAST(('0x' || substr(sha256(c_name), 1, 8)) AS BIGINT) % 10000 AS VARCHAR) AS phone FROM customer"""
_REPORT = f"WITH m AS ({_MASKED}), r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS total, count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS masked FROM m" for c, p in _FORMS.items()) + ")"


@query(_REPORT + " SELECT *, total - masked AS violations, CASE WHEN total - masked = 0 THEN 'PASS' WHEN total - masked <= 200 THEN 'WARN' ELSE 'FAIL' END AS status FROM r")
def audit_mask_report(spark, d):
    return audit.mask_report(sync_mask_customer(spark, d), _FORMS, warn_at=200)


@query(_REPORT + " SELECT sum(total - masked)::BIGINT AS total_violations, CASE WHEN sum(total - masked) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r")
def audit_verdict(spark, d):
    return audit.verdict(audit.mask_report(sync_mask_customer(spark, d), _FORMS))


def _fk_sql(child, column, parent, key, where="TRUE"):
    p = f"(SELECT DISTINCT {key} FROM {parent} WHERE {where} AND {key} IS NOT NULL)"
    return f"SELECT '{child}.{column}' AS reference, count({column}) AS total, count({key}) AS valid, count({column}) - count({key}) AS violations FROM {child} LEFT JOIN {p} ON {column} = {key}"


def _fk(spark, d, child, column, parent, key, where="TRUE"):
    return audit.fk_audit(table(spark, d, child), column, table(spark, d, parent).filter(where), key, f"{child}.{column}")


@query(_fk_sql("orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"))
def fk_orders_customer(spark, d):
    return _fk(spark, d, "orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0")


@query(_fk_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "o_totalprice > 100000"))
def fk_lineitem_orders(spark, d):
    return _fk(spark, d, "lineitem", "l_orderkey", "orders", "o_orderkey", "o_totalprice > 100000")


@query(_fk_sql("nation", "n_regionkey", "region", "r_regionkey", "r_name <> 'ASIA'"))
def fk_nation_region(spark, d):
    return _fk(spark, d, "nation", "n_regionkey", "region", "r_regionkey", "r_name <> 'ASIA'")


@query(" UNION ALL ".join(_fk_sql(*r) for r in REFERENCES))
def fk_all_references(spark, d):
    return audit.union_all([_fk(spark, d, *r) for r in REFERENCES])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 100000) AND l_orderkey IS NOT NULL")
def orphan_rows(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 100000")
    return audit.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", rich, "o_orderkey")


@query("SELECT sha256(text) AS text_hash, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, d):
    return audit.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash")), ["text_hash"])


_NULLED = "SELECT nullif(user_id % 7, 0) AS user_bucket, nullif(event_type, 'click') AS event_type, value FROM events"


@query(f"WITH e AS ({_NULLED}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / nullif(count(*), 0), 2)::DOUBLE AS pct_null FROM e" for c in ("user_bucket", "event_type", "value")))
def null_profile(spark, d):
    e = table(spark, d, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("user_bucket"), F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    p = audit.null_profile(e)
    return p.select("column_name", "n_rows", "n_null", F.col("pct_null").cast("double").alias("pct_null"))


@query(f"""WITH e AS ({_NULLED}) SELECT 'not_null:user_bucket' AS rule, count(*) FILTER (WHERE user_bucket IS NULL) AS violations FROM e
  UNION ALL SELECT 'not_null:event_type', count(*) FILTER (WHERE event_type IS NULL) FROM e UNION ALL SELECT 'check:small', count(*) FILTER (WHERE NOT (value < 50)) FROM e""")
def constraint_violations(spark, d):
    e = table(spark, d, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("user_bucket"), F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    return audit.violations(e, ["user_bucket", "event_type"], {"small": "value < 50"})


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
_KEPT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" + (f" WHERE {KEYS[t]} % 3 > 0" if t in ("orders", "part") else "") for t in TABLES if t != "events")


def _counts(spark, d):
    return counts({t: table(spark, d, t) for t in TABLES})


def _kept(spark, d):
    return counts({t: table(spark, d, t).filter(f"{KEYS[t]} % 3 > 0" if t in ("orders", "part") else "TRUE") for t in TABLES if t != "events"})


@query(f"WITH s AS ({_COUNTS}), t AS ({_KEPT}) SELECT s.table_name, s.n_rows AS source_rows, coalesce(t.n_rows, 0) AS target_rows, coalesce(t.n_rows, 0) - s.n_rows AS difference, coalesce(t.n_rows, 0) = s.n_rows AS matches FROM s LEFT JOIN t USING (table_name)")
def reconcile_counts(spark, d):
    return audit.reconcile(_counts(spark, d), _kept(spark, d))


@query(f"WITH s AS ({_COUNTS}), t AS ({_KEPT}) SELECT s.table_name, s.n_rows AS before, coalesce(t.n_rows, 0) AS after, coalesce(t.n_rows, 0) >= s.n_rows AS ok FROM s LEFT JOIN t USING (table_name)")
def no_data_loss(spark, d):
    return audit.no_data_loss(_counts(spark, d), _kept(spark, d))


@query(f"""WITH s AS ({_COUNTS}) SELECT table_name, n_rows, CASE WHEN n_rows >= 50000 THEN 'copy' ELSE 'fdw' END AS strategy,
  CASE WHEN n_rows = 0 THEN 0.0 ELSE greatest(0.001, round(n_rows / (CASE WHEN n_rows >= 50000 THEN 6000000 ELSE 500000 END), 3)) END::DOUBLE AS estimated_seconds, n_rows >= 100000 AS is_large FROM s""")
def strategy_advice(spark, d):
    return audit.strategy_advice(_counts(spark, d), copy_from=50_000)


@query(f"SELECT sum(n_rows)::BIGINT AS total_rows, count(*) AS n_tables FROM ({_COUNTS})")
def sync_totals(spark, d):
    return _counts(spark, d).agg(F.sum("n_rows").alias("total_rows"), F.count("*").alias("n_tables"))


_NOW = [("copy", 120.0), ("mask", 400.0), ("load", 90.0), ("check", 10.0)]
_THEN = [("copy", 100.0), ("mask", 300.0), ("load", 80.0), ("swap", 5.0)]
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if not isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


@query(f"SELECT n.operation, t.ms AS baseline_ms, n.ms AS current_ms, round(n.ms / t.ms, 4) AS ratio FROM (VALUES {_values(_NOW)}) n(operation, ms) JOIN (VALUES {_values(_THEN)}) t(operation, ms) USING (operation) WHERE n.ms > t.ms * 1.15".replace("120.0", "120.0::DOUBLE").replace("100.0)", "100.0::DOUBLE)"))
def regression_detect(spark, d):
    of = lambda r: spark.createDataFrame(r, "operation string, ms double")
    return audit.regressions(of(_NOW), of(_THEN), 1.15)


@query(f"SELECT operation, ms::DOUBLE AS ms FROM (VALUES {_values(_NOW)}) n(operation, ms) WHERE ms >= 0.05 * (SELECT sum(ms) FROM (VALUES {_values(_NOW)}) x(operation, ms))")
def bottleneck_operations(spark, d):
    return audit.bottlenecks(spark.createDataFrame(_NOW, "operation string, ms double"))


_EXPECTED = [("users", "id", "bigint", False), ("users", "email", "text", False), ("users", "age", "integer", True), ("posts", "id", "bigint", False), ("tags", "id", "bigint", False)]
_LIVE = [("users", "id", "bigint", False), ("users", "email", "varchar(80)", True), ("users", "nick", "text", True), ("posts", "id", "bigint", False), ("logs", "id", "bigint", False)]


@query(f"""WITH e(table_name, column_name, type, nullable) AS (VALUES {_values(_EXPECTED)}), l(table_name, column_name, type, nullable) AS (VALUES {_values(_LIVE)}),
  t AS (SELECT DISTINCT table_name FROM e INTERSECT SELECT DISTINCT table_name FROM l),
  c AS (SELECT coalesce(e.table_name, l.table_name) AS table_name, coalesce(e.column_name, l.column_name) AS column_name, e.type AS et, l.type AS lt, e.nullable AS en, l.nullable AS ln
    FROM (SELECT * FROM e WHERE table_name IN (FROM t)) e FULL JOIN (SELECT * FROM l WHERE table_name IN (FROM t)) l ON e.table_name = l.table_name AND e.column_name = l.column_name)
  SELECT DISTINCT table_name, NULL::VARCHAR AS column_name, 'missing_table' AS kind, 'critical' AS severity FROM e WHERE table_name NOT IN (FROM t)
  UNION ALL SELECT DISTINCT table_name, NULL, 'extra_table', 'info' FROM l WHERE table_name NOT IN (FROM t)
  UNION ALL SELECT table_name, column_name, 'missing_column', 'critical' FROM c WHERE lt IS NULL UNION ALL SELECT table_name, column_name, 'extra_column', 'info' FROM c WHERE et IS NULL
  UNION ALL SELECT table_name, column_name, 'type_mismatch', 'critical' FROM c WHERE et <> lt UNION ALL SELECT table_name, column_name, 'nullable_mismatch', 'warning' FROM c WHERE en <> ln""")
def drift_report(spark, d):
    of = lambda r: spark.createDataFrame(r, "table_name string, column_name string, type string, nullable boolean")
    return schema.drift(of(_EXPECTED), of(_LIVE))


@query(f"""WITH e(table_name, column_name, type, nullable) AS (VALUES {_values(_EXPECTED)}), l(table_name, column_name, type, nullable) AS (VALUES {_values(_LIVE)})
  SELECT table_name, column_name, 'added' AS change FROM (SELECT table_name, column_name FROM l EXCEPT SELECT table_name, column_name FROM e)
  UNION ALL SELECT table_name, column_name, 'dropped' FROM (SELECT table_name, column_name FROM e EXCEPT SELECT table_name, column_name FROM l)""")
def set_diff_schema(spark, d):
    of = lambda r: spark.createDataFrame(r, "table_name string, column_name string, type string, nullable boolean")
    return schema.set_difference(of(_EXPECTED), of(_LIVE), ["table_name", "column_name"])


_TYPES = ["smallint", "integer", "bigint", "text"]
_RANK = "CASE {0} WHEN 'smallint' THEN 1 WHEN 'integer' THEN 2 WHEN 'bigint' THEN 3 ELSE 4 END"


@query(f"""WITH t(n) AS (VALUES {_values([(t,) for t in _TYPES])}) SELECT a.n AS old_type, b.n AS new_type,
  CASE WHEN a.n = b.n THEN 'identical' WHEN {_RANK.format('b.n')} > {_RANK.format('a.n')} THEN 'widening' ELSE 'narrowing' END AS direction FROM t a, t b""")
def type_lattice_matrix(spark, d):
    return spark.createDataFrame([(a, b, schema.direction(a, b)) for a in _TYPES for b in _TYPES], "old_type string, new_type string, direction string")


_PAIRS = [("user_name", "user_name"), ("user_name", "user_label"), ("full_name", "display_name"), ("abc", "cab"), ("abc", "xyz"), ("a_b_c", "x_b_y")]


@query(f"""WITH p(a, b) AS (VALUES {_values(_PAIRS)}), s AS (SELECT *, string_split(a, '_') AS x, string_split(b, '_') AS y, list_distinct(string_split(a, '')) AS u, list_distinct(string_split(b, '')) AS v FROM p)
  SELECT a, b, (CASE WHEN a = b THEN 1.0 WHEN x[1] = y[1] OR x[-1] = y[-1] THEN 0.6 WHEN len(list_intersect(x, y)) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y)))
    ELSE len(list_intersect(u, v))::DOUBLE / len(list_distinct(list_concat(u, v))) END)::DOUBLE AS score FROM s""")
def rename_similarity(spark, d):
    return spark.createDataFrame(_PAIRS, "a string, b string").select("a", "b", schema.similarity_column(F.col("a"), F.col("b")).cast("double").alias("score"))


_EDGES = [("tb_machine", "v_machine"), ("v_machine", "v_status"), ("tb_part", "v_part"), ("v_machine", "v_part"), ("v_part", "v_report"), ("v_status", "v_report"), ("tb_other", "v_other")]


@query(f"""WITH RECURSIVE e(parent, child) AS (VALUES {_values(_EDGES)}), deps(name, depth) AS (SELECT child, 1 FROM e WHERE parent = 'tb_machine'
  UNION ALL SELECT e.child, d.depth + 1 FROM e JOIN deps d ON e.parent = d.name) SELECT name, max(depth)::INT AS depth FROM deps GROUP BY name""")
def view_dependency_closure(spark, d):
    return control.view_closure(spark, spark.createDataFrame(_EDGES, "parent string, child string"), ["tb_machine"])


_FILES = [("001", "init", True), ("002", "users", True), ("003", "posts", False), ("004", "tags", True)]
_APPLIED = [("001", "init"), ("002", "users"), ("003", "posts")]


def _ledger(spark):
    return spark.createDataFrame(_FILES, "version string, name string, has_down boolean"), spark.createDataFrame(_APPLIED, "version string, name string")


@query(f"SELECT * FROM (VALUES {_values(_FILES)}) f(version, name, has_down) WHERE version NOT IN (SELECT version FROM (VALUES {_values(_APPLIED)}) a(version, name))")
def ledger_pending(spark, d):
    return control.pending(*_ledger(spark))


@query(f"SELECT row_number() OVER (ORDER BY version DESC)::INT AS step, version, name, has_down AS can_roll_back FROM (VALUES {_values(_FILES)}) f(version, name, has_down) WHERE version > '001' AND version <= '003'")
def rollback_plan(spark, d):
    files, applied = _ledger(spark)
    return control.rollback_plan(applied, files, "001")


_SUMS = [("001", "a"), ("002", "b"), ("003", "c")]


@query("WITH f(version, checksum) AS (VALUES ('001', 'a'), ('002', 'x')), s(version, checksum) AS (VALUES " + _values(_SUMS) + ") SELECT s.version, CASE WHEN f.version IS NULL THEN 'missing_file' ELSE 'changed' END AS kind FROM s LEFT JOIN f USING (version) WHERE f.version IS NULL OR f.checksum <> s.checksum")
def checksum_verify(spark, d):
    of = lambda r: spark.createDataFrame(r, "version string, checksum string")
    return control.verify_checksums(of([("001", "a"), ("002", "x")]), of(_SUMS))


_CHANGES = [("m1", "safe"), ("m1", "high"), ("m2", "low"), ("m2", None), ("m3", None), ("m4", "critical"), ("m4", "medium")]


@query(f"""SELECT migration, CASE max(CASE tier WHEN 'safe' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END)
  WHEN 0 THEN 'safe' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' END AS worst_tier FROM (VALUES {_values(_CHANGES)}) c(migration, tier) GROUP BY migration""")
def risk_worst_tier(spark, d):
    return control.worst_tier(spark.createDataFrame(_CHANGES, "migration string, tier string"), ["migration"])


@query("SELECT * FROM (VALUES (1, 'r', 5::BIGINT), (2, 'n', (SELECT count(*) FROM nation WHERE n_regionkey < 3)), (3, '(main)', (SELECT count(DISTINCT r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3))) t(step, name, n_rows)")
def cte_debug_steps(spark, d):
    for t in ("region", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"cte_{t}")
    sql = "WITH r AS (SELECT * FROM cte_region), n AS (SELECT r_name, n_name FROM cte_nation JOIN r ON n_regionkey = r_regionkey WHERE n_regionkey < (1 + 2)) SELECT r_name, count(*) AS n FROM n GROUP BY r_name"
    return spark.createDataFrame([(s["step"], s["name"], s["n_rows"]) for s in control.debug_ctes(spark, sql)], "step int, name string, n_rows long")


_INTENTS = [(1, "a", ["users.id", "posts"]), (2, "b", ["posts", "tags"]), (3, "a", ["posts"]), (4, "c", ["logs"])]


@query("WITH i AS (SELECT id, agent, unnest(objects) AS o FROM (VALUES " + _values(_INTENTS) + ") t(id, agent, objects)) SELECT x.id AS a, y.id AS b, list_sort(list(DISTINCT x.o)) AS objects FROM i x JOIN i y ON x.o = y.o AND x.id < y.id AND x.agent <> y.agent GROUP BY x.id, y.id")
def intent_conflicts(spark, d):
    return control.conflicts(spark.createDataFrame(_INTENTS, "id int, agent string, objects array<string>"))


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation')")
def schema_facts(spark, d):
    facts = column_facts({t: table(spark, d, t) for t in ("region", "nation")})
    return spark.createDataFrame([(t, c) for t, c, _, _ in facts], "table_name string, column_name string")


_VERIFIED = {
    "orders_have_customers": "SELECT count(*) = 0 FROM {orders} WHERE o_custkey IS NULL", "prices_are_low": "SELECT max(o_totalprice) < 1000 FROM {orders}",
    "regions": "SELECT count(*) FROM {region} WHERE r_name LIKE 'A%'", "no_such_region": "SELECT count(*) FROM {region} WHERE r_name LIKE 'X%'"}
_PLAIN = {"orders": "orders", "region": "region"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, ({q.format(**_PLAIN)})::BOOLEAN AS ok" for n, q in _VERIFIED.items())
       + " UNION ALL SELECT 'rows:' || n, (SELECT count(*) FROM region) = n FROM (VALUES (5), (6)) v(n) UNION ALL SELECT 'column:' || c, c IN (SELECT column_name FROM information_schema.columns WHERE table_name = 'region') FROM (VALUES ('r_name'), ('r_nothing')) v(c)")
def verify_query(spark, d):
    """Verification queries and preconditions, some of them not met."""
    views = {t: f"verify_{t}" for t in _PLAIN}
    for t, v in views.items():
        table(spark, d, t).createOrReplaceTempView(v)
    found = [(n, audit.verify_query(spark, q.format(**views))[0]) for n, q in _VERIFIED.items()]
    names = ["rows:5", "rows:6", "column:r_name", "column:r_nothing"]
    checks = [audit.row_count("verify_region", 5), audit.row_count("verify_region", 6), audit.column_exists("verify_region", "r_name"), audit.column_exists("verify_region", "r_nothing")]
    found += [(n, ok) for n, (_, ok, _) in zip(names, audit.run_checks(spark, checks))]
    return spark.createDataFrame(found, "name string, ok boolean")
