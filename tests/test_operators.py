import pytest
from pyspark.sql import functions as F

from millrace.functions.registry import Policy, Rule
from millrace.operators import audit, control, movement as mv, schema
from millrace.plans import ORACLES, QUERIES
from millrace.sources import catalog, seeds
from millrace.streaming import masked_increment, upsert_increment, windowed_totals


@pytest.mark.parametrize("a,b,want", [
    ("int", "bigint", "widening"), ("bigint", "int4", "narrowing"), ("int", "integer", "identical"), ("varchar(10)", "varchar(20)", "widening"),
    ("varchar(20)", "varchar(10)", "narrowing"), ("varchar(10)", "text", "widening"), ("text", "varchar", "narrowing"), ("numeric(10,2)", "numeric(12,2)", "widening"),
    ("numeric(10,2)", "numeric(10,4)", "narrowing"), ("timestamp", "timestamptz", "lateral"), ("date", "timestamp", "widening"), ("json", "jsonb", "lateral"),
    ("int[]", "int", "lateral"), ("int[]", "int[]", "identical"), ("???", "int", "unknown"), ("timestamp with time zone", "timestamptz", "identical"),
])
def test_type_lattice(a, b, want):
    assert schema.direction(a, b) == want


def test_types():
    assert schema.needs_rewrite("int", "bigint") and not schema.needs_rewrite("varchar(5)", "text") and not schema.needs_rewrite("int", "int4")
    assert schema.canonical_type("DECIMAL(10, 2)") == "numeric(10,2)" and schema.canonical_type("int4[]") == "integer[]"
    assert schema.SqlType.parse("numeric(12,3)[]").spark() == "array<decimal(12,3)>" and schema.SqlType.parse("int4range").spark().startswith("struct<lower:int")


DDL = """
-- users; with a semicolon
CREATE TABLE users (id bigint PRIMARY KEY, email varchar(80) NOT NULL UNIQUE, age int DEFAULT 3, note text DEFAULT 'a;b');
CREATE TABLE posts (id bigint, user_id bigint NOT NULL REFERENCES users(id) ON DELETE CASCADE, PRIMARY KEY (id), CONSTRAINT ck CHECK (id > 0));
CREATE INDEX ix ON posts (user_id); CREATE TYPE mood AS ENUM ('sad', 'ok'); CREATE SEQUENCE s1;
CREATE FUNCTION f() RETURNS int AS $x$ BEGIN; END; $x$ LANGUAGE plpgsql;
"""


def test_ddl_and_diff():
    old = schema.parse_ddl(DDL)
    assert old.tables == ["posts", "users"] and old.references() == [("posts", "users")] and len(schema.statements(DDL)) == 6
    assert [c for c in old.columns if c["column"] == "email"][0] == {"table": "users", "column": "email", "type": "varchar(80)", "nullable": False, "default": "", "primary": False}
    new = schema.parse_ddl(DDL.replace("email varchar(80)", "email_addr varchar(90)").replace("age int DEFAULT 3", "age bigint").replace("'ok'", "'ok', 'glad'").replace("CREATE SEQUENCE s1;", "").replace("CREATE INDEX ix", "CREATE INDEX iy"))
    got = {(c["change"], c["table"], c["column"]) for c in schema.diff(old, new)}
    assert {("rename_column", "users", "email"), ("alter_type", "users", "email"), ("alter_type", "users", "age"), ("alter_default", "users", "age"), ("add_enum_value", "mood", ""), ("drop_sequence", "s1", ""), ("drop_index", "posts", "ix"), ("add_index", "posts", "iy")} <= got
    assert schema.diff(old, old) == []
    assert schema.to_sql({"change": "add_column", "table": "t", "column": "c", "old": "", "new": "int"}) == ("ALTER TABLE t ADD COLUMN c int", "ALTER TABLE t DROP COLUMN c")
    ddl, later = schema.extract_foreign_keys(DDL)
    assert "REFERENCES" not in ddl and later == ["ALTER TABLE posts ADD FOREIGN KEY (user_id) REFERENCES users(id) ON DELETE CASCADE"]
    assert not [x for x in schema.lint(old) if x[0] == "foreign_key_index"] and schema.unclosed_comment("/* a") and not schema.unclosed_comment("/* a */ '/*'")


def test_renames_are_one_to_one():
    assert schema.renames(["full_name", "last_name"], ["display_name"]) == [("full_name", "display_name")]
    assert schema.similarity("a", "a") == 1 and schema.similarity("user_id", "user_key") == 0.6


@pytest.mark.parametrize("edges,want", [
    ([], []), ([("b", "a"), ("c", "b")], [["a"], ["b"], ["c"]]), ([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], [["a"], ["b", "c"], ["d"]]),
    ([("a", "b"), ("b", "a"), ("c", "x")], [["x"], ["c"], ["a", "b"]]), ([("a", "a")], [["a"]]),
])
def test_topological(edges, want):
    assert schema.topological(edges) == want
    assert schema.reachable([("c", "b"), ("b", "a"), ("a", "b")], "c") == ["a", "b"]


def test_hash_and_baseline(spark):
    assert schema.schema_hash({"b": "2", "a": "1"}) == schema.schema_hash({"a": "1", "b": "2"}) != schema.schema_hash({"a": "12", "b": ""})
    assert schema.detect_baseline("create  table T(x int)", {"1": "CREATE TABLE t(x int) -- c", "2": "drop everything now"}) == ("1", 1.0)
    of = lambda r: spark.createDataFrame(r, "name string, body string")
    assert {tuple(r) for r in schema.body_drift(of([("v", "SELECT  1"), ("w", "x"), ("g", "y")]), of([("v", "select 1"), ("w", "z"), ("n", "y")])).collect()} == {("w", "changed"), ("g", "missing"), ("n", "extra")}


def test_control(spark):
    assert [control.risk(s) for s in ("DROP TABLE x", "ALTER TABLE a DROP COLUMN b", "update t set a=1", "update t set a=1 where b", "alter table a add column b int", "CREATE TABLE a (x int)", "vacuum")] == ["critical", "critical", "high", "medium", "low", "safe", None]
    assert [c["tier"] for c in control.change_set("CREATE TABLE a(x int); DROP TABLE b")] == ["safe", "critical"]
    assert control.inverse("CREATE TABLE a (x int)")[0] == "DROP TABLE a" and control.inverse("alter table a rename to b")[0] == "ALTER TABLE b RENAME TO a" and control.inverse("DROP TABLE a")[0] is None
    steps, main = control.ctes("WITH a AS (SELECT ')' AS x), b (y) AS (SELECT (1 + (2))) SELECT * FROM a")
    assert [n for n, _ in steps] == ["a", "b"] and main == "SELECT * FROM a" and control.ctes("SELECT 1") == ([], "SELECT 1")
    got = control.debug_ctes(spark, "WITH a AS (SELECT 1 AS x), b AS (SELECT nope FROM a) SELECT * FROM b")
    assert [s["name"] for s in got] == ["a", "b"] and got[0]["n_rows"] == 1 and got[1]["error"]
    assert audit.critical_path([{"start": 0, "end": 5}, {"start": 1, "end": 2}, {"start": 5, "end": 6}]) == [{"start": 0, "end": 5}, {"start": 5, "end": 6}]


def test_audit_edges(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [tuple(r) for r in audit.null_profile(empty).collect()] == [(0, "a", 0, None), (0, "b", 0, None)]
    assert audit.fk_audit(empty, "a", empty, "a", "x").first()["total"] == 0 and audit.verdict(audit.mask_report(empty, {"b": "x"})).first()["verdict"] == "PASS"
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a int, b string")
    assert {tuple(r) for r in audit.violations(df, ["a"], {"c": "a > 2"}).collect()} == {("not_null:a", 1), ("check:c", 1)}
    assert [audit.truthy(v) for v in (None, 0, 1, "yes", "no", True)] == [False, False, True, True, False, True]
    with pytest.raises(ValueError):
        audit.verify_query(spark, "DROP TABLE x")
    assert audit.verify_query(spark, "SELECT 1 WHERE false") == (False, "no rows")
    bad = audit.run_checks(spark, [audit.table_exists("nope"), audit.custom_sql("q", "SELECT broken")], stop=False)
    assert [ok for _, ok, _ in bad] == [False, False] and len(audit.run_checks(spark, [audit.table_exists("nope"), audit.table_missing("nope")], stop=True)) == 1
    assert audit.batch_progress(50, 100, 10) == {"percent": 50.0, "rows_per_second": 5.0, "seconds_left": 10.0}


def test_rewrites(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(mv.backfill(df, "v", "'z'", "v = 'a'")) == [(1, "z"), (2, None), (3, "c")]
    assert rows(mv.delete_where(df, "v = 'a'")) == [(2, None), (3, "c")] and rows(mv.add_column(df, "v", "'d'")) == [(1, "a"), (2, "d"), (3, "c")]
    new = spark.createDataFrame([(3, "n"), (4, "m"), (4, "k")], "id int, v string")
    assert rows(mv.insert_missing(df, new, ["id"])) == [(1, "a"), (2, None), (3, "c"), (4, "k")]
    assert rows(mv.upsert(df, new.filter("v <> 'k'"), ["id"])) == [(1, "a"), (2, None), (3, "n"), (4, "m")]
    with pytest.raises(ValueError):
        mv.remap(df, {})
    b = mv.with_batches(spark.range(10).repartition(3).select(F.col("id").alias("k")), "k", 4)
    assert sorted((r["k"], r["batch_id"]) for r in b.collect()) == [(i, i // 4) for i in range(10)]


def test_sync_resumes_and_verifies(spark, sf, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    s = mv.Sync(spark, f"file://{sf}", target, Policy({"customer": [Rule("c_name", "sync_name")]}))
    led = mv.Ledger(spark, target + "/_ledger")
    one = s.one
    monkeypatch.setattr(s, "one", lambda n: (_ for _ in ()).throw(RuntimeError("lost")) if n == "region" else one(n))
    with pytest.raises(RuntimeError):
        s.run(["customer", "nation", "region"], run_id="r", ledger=led)
    assert led.done("r") == {"customer", "nation"}
    monkeypatch.setattr(s, "one", one)
    assert [m.table for m in s.run(["customer", "nation", "region"], run_id="r", ledger=led)] == ["region"]
    assert s.read("customer").filter("c_name NOT LIKE 'User %'").count() == 0 and s.read("region").count() == 5
    assert mv.migrate(s.read("region"), {"r_name": "name"}, target + "/names") == 5 == mv.migrate(s.read("region"), {"r_name": "name"}, target + "/names")


def test_catalog(spark, sf):
    names = catalog.list_tables(spark, sf)
    assert "orders" in names and names == sorted(names) and catalog.select_tables(names, ["orders"], ["o*"]) == []
    assert catalog.import_schema(spark, sf, "old", ["region"]) == ["old__region"] and spark.table("old__region").count() == 5 and catalog.drop_schema(spark, "old") == 1


def test_copy_text(spark):
    df = spark.createDataFrame([("a\tb", None, "c\\d\ne\r", ""), ("\b\f", "\\N", "x", "é")], "a string, b string, c string, d string")
    lines = seeds.copy_lines(df, "value")
    assert lines.first()[0] == "a\\tb\t\\N\tc\\\\d\\ne\\r\t"
    assert seeds.read_copy(lines, df.columns).collect() == df.collect()
    block = seeds.copy_block("t", ["a", "b"], [("x\ty", None), (True, 1)])
    assert seeds.parse_copy(block) == [("t", ["a", "b"], [["x\ty", None], ["true", "1"]])]


@pytest.mark.parametrize("sql,why", [
    ("INSERT INTO t (a) SELECT 1", "INSERT … SELECT"), ("INSERT INTO t (a) VALUES (1) ON CONFLICT DO NOTHING", "ON CONFLICT"), ("INSERT INTO t (a) VALUES (now())", "function call"),
    ("INSERT INTO t (a) VALUES (1 + 2)", "expression"), ("INSERT INTO t (a) VALUES ('x' || 'y')", "concatenation"), ("INSERT INTO t (a) VALUES (CASE WHEN true THEN 1 END)", "CASE"),
    ("INSERT INTO t (a) VALUES ((SELECT 1))", "subquery"), ("INSERT INTO t (a) VALUES (1) RETURNING a", "RETURNING"), ("DELETE FROM t", "not an INSERT"), ("INSERT INTO t VALUES (1)", "no column list"),
    ("INSERT INTO t (a, b) VALUES ('now() - it''s; (x)', -1), (NULL, true)", None),
])
def test_insert_conversion(sql, why):
    assert seeds.why_not(sql) == why


def test_seeds(spark, tmp_path):
    sql = "INSERT INTO t (a, b) VALUES ('it''s', NULL); INSERT INTO u (a) VALUES (1); INSERT INTO t (a, b) VALUES ('y', true);\nSELECT 1;"
    i = seeds.parse_insert(seeds.statements(sql)[0])
    assert (i.table, i.columns, i.rows) == ("t", ["a", "b"], [["it's", None]])
    out = seeds.to_copy(sql)
    assert out.count("COPY") == 2 and out.index("COPY t") < out.index("COPY u") < out.index("SELECT 1;") and "it's\t\\N\ny\ttrue" in out
    assert seeds.convert_files({"a": sql, "b": "SELECT 1"})[1]["failed"] == 1
    files = {"1.sql": "INSERT INTO t (a) VALUES ('x'), (NULL);", "2.sql": "BEGIN; INSERT INTO t (a) VALUES ('y');", "3.sql": seeds.copy_block("t", ["a"], [("z",)])}
    got = seeds.apply_files(spark, files, str(tmp_path), keep_going=True)
    assert (got.total, got.rows, list(got.failed)) == (3, 3, ["2.sql"]) and spark.read.parquet(f"{tmp_path}/t.parquet").count() == 3
    assert {r for r, _ in seeds.lint("SELECT 1;; INSERT INTO t (id) VALUES ('aaaaaaaa-bbbb-cccc-dddd-zzzzzzzzzzzz');")} == {"double_semicolon", "not_an_insert", "no_on_conflict", "bad_uuid"}
    assert not [r for r, _ in seeds.lint(seeds.fix("INSERT INTO t (id) VALUES (1);;"))]
    assert seeds.hex_order(["z.sql", "0A_b.sql", "9_a.sql"]) == ["9_a.sql", "0A_b.sql", "z.sql"]
    for n in ("b.sql", "a.sql", "skip_a.sql", "c.txt"):
        (tmp_path / n).write_text("x")
    assert [p.name for p in seeds.find_files(str(tmp_path), exclude=["skip*"])] == ["a.sql", "b.sql"]
    assert seeds.stub("t", ["a"], 2).count("<a_") == 2


def test_streams(spark, sf, tmp_path):
    e = catalog.table(spark, sf, "events")
    src = f"{tmp_path}/in"
    e.limit(100).write.parquet(src)
    p = Policy({"e": [Rule("event_type", "sync_redact")]})
    run = lambda: masked_increment(spark, src, f"{tmp_path}/out", f"{tmp_path}/state", p, "e")
    assert run() == 100 == run()
    e.limit(10).write.mode("append").parquet(src)
    assert run() == 110
    upsert_increment(spark, src, f"{tmp_path}/latest", f"{tmp_path}/s2", ["event_id"], "ts")
    assert spark.read.parquet(f"{tmp_path}/latest/v0").count() == 100
    assert windowed_totals(spark.readStream.schema(e.schema).parquet(src)).isStreaming


def test_late_rows_do_not_replace_newer_ones(spark, tmp_path):
    src, run = f"{tmp_path}/in", lambda: upsert_increment(spark, src, f"{tmp_path}/latest", f"{tmp_path}/s", ["k"], "ts")
    add = lambda *r: spark.createDataFrame(list(r), "k int, ts int, v string").coalesce(1).write.mode("append").parquet(src)
    add((1, 10, "new"), (2, 1, "a"))
    run()
    add((1, 5, "late"), (2, 1, "b"), (3, 7, "x"))
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/latest/v1").collect())) == [(1, 10, "new"), (2, 1, "b"), (3, 7, "x")]


def test_batches_lose_no_rows(spark, tmp_path, capsys):
    """All columns at scale factor 0.1, written; a hot key and nulls."""
    root = "/root/testdata/sf0.1"
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        df = catalog.table(spark, root, name)
        mv.with_batches(df, key, 5000).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        n = df.count()
        r = got.agg(F.count("*"), F.countDistinct("row_num"), F.min("row_num"), F.max("row_num")).first()
        assert tuple(r) == (n, n, 1, n) and got.groupBy("batch_id").count().filter("count > 5000").isEmpty()
    mv.with_batches(df, key, 5000).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(__part") == 2  # the rows once, and the ranges' sizes
    rows = [(None,)] * 5 + [(7,)] * 400 + [(i,) for i in range(100)]
    got = mv.with_batches(spark.createDataFrame(rows, "k int"), "k", 50).orderBy("row_num").collect()
    assert [r["k"] for r in got] == sorted((k for k, in rows), key=lambda k: -1 if k is None else k) and [r["row_num"] for r in got] == list(range(1, 506))


def test_batches_do_not_depend_on_the_order_of_rows(spark):
    """Rows that share key and ties; a name with a dot, and types without an order."""
    rows = [(i // 4, i % 2, f"v{i:02}", {"a": i}) for i in range(40)]
    of = lambda r, n: spark.createDataFrame(r, "k int, t int, `v.x` string, m map<string,int>").coalesce(n)
    got = [sorted((r["v.x"], r["row_num"], r["batch_id"]) for r in mv.with_batches(of(r, n), "k", 3, ["t"]).collect()) for r, n in ((rows, 4), (rows[::-1], 1), (rows[::3] + rows[1::3] + rows[2::3], 2))]
    want = sorted(rows, key=lambda r: r[:3])
    assert got[0] == got[1] == got[2] == sorted((r[2], i + 1, i // 3) for i, r in enumerate(want))


def test_lineitem_batches_agree_between_layouts(spark):
    """Rows of lineitem share date, order and line number: their batches don't depend on how the table is laid out."""
    d = "/root/testdata/sf0.01"
    x = catalog.table(spark, d, "lineitem")
    assert x.groupBy("l_shipdate", "l_orderkey", "l_linenumber").count().filter("count > 1").count() > 0
    one = QUERIES["batches_of_lineitem"](spark, d)
    two = mv.with_batches(x.repartition(7).sortWithinPartitions(F.desc("l_partkey"), F.desc("l_suppkey")), "l_shipdate", 5000, ["l_orderkey", "l_linenumber"])
    assert one.exceptAll(two.withColumn("row_num", F.col("row_num").cast("long")).select(one.columns)).count() == 0


@pytest.mark.parametrize("name", ["batches_of_lineitem", "batches_of_orders", "batch_tracker"])
def test_batches_place_nulls_as_their_sql_does(spark, tmp_path, name):
    """Nulls in each column that the SQL orders by, no ties; more rows than a batch of orders holds."""
    import duckdb

    n = F.col("id")
    lineitem = spark.range(3, 700).select(F.when(n % 7 > 0, F.timestamp_seconds(n % 5 * 86400).cast("timestamp_ntz")).alias("l_shipdate"), F.when(n != 50, F.floor(n / 3)).alias("l_orderkey"), F.when(n % 3 > 0, n % 3).alias("l_linenumber"))
    orders = spark.range(1500).select(F.when(n != 70, n).alias("o_orderkey"))
    duck = duckdb.connect()
    for of, df in (("lineitem", lineitem), ("orders", orders)):
        df.write.parquet(f"{tmp_path}/{of}.parquet")
        duck.sql(f"CREATE VIEW {of} AS SELECT * FROM read_parquet('{tmp_path}/{of}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.sql(ORACLES[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_views_are_saved_and_made_again(spark):
    spark.range(3).createOrReplaceTempView("base_t")
    sql = {"v1": "SELECT id FROM base_t", "v2": "SELECT id + 1 AS id FROM v1", "v3": "SELECT a.id FROM v1 a JOIN v2 b ON a.id = b.id"}
    views = control.Views(spark, sql, {"v1": ["base_t"], "v2": ["v1"], "v3": ["v1", "v2"]})
    for n, q in sql.items():
        spark.sql(q).createOrReplaceTempView(n)
    assert views.drop("base_t") == ["v3", "v2", "v1"] and not spark.catalog.tableExists("v1")
    assert views.recreate() == ["v1", "v2", "v3"] and spark.table("v3").count() == 2
    with pytest.raises(ValueError):
        control.view_closure(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), ["a"])


def test_files_and_logs(spark, tmp_path):
    assert seeds.concatenated({"a.sql": "x;\n", "b.sql": "y;"}, "-- head\n").count("==========") == 4
    (tmp_path / "a.sql").write_text("SELECT 1")
    r = seeds.read_files(spark, [f"{tmp_path}/a.sql"]).first()
    assert r["text"] == "SELECT 1" and len(r["sha256"]) == 64
    assert mv.Metrics("t", 10, 2.0).rows_per_second == 5 and mv.Metrics("t", 1, 0.0).rows_per_second == 0
    log = spark.createDataFrame([("e", "before", 3), ("e", "before", 4), ("f", "after", 1)], "execution_id string, phase string, duration_ms int")
    assert [tuple(x) for x in audit.execution_log(log, "e", "before").collect()] == [("e", "before", 2, 7)]
    names = {"fk_orders", "ix_orders"}
    assert [ok for _, ok, _ in audit.run_checks(spark, [audit.declared("index", names, "ix_orders"), audit.declared("foreign key", names, "fk_x"), audit.declared("constraint", names, "c", False), audit.schema_missing("nowhere")])] == [True, False, True, True]
