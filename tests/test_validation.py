from millrace.operators import validation as v
from millrace.operators.schema import parse_ddl


def test_levels(spark):
    ddl = "CREATE TABLE tb_maker (id uuid, pk_maker bigint PRIMARY KEY, parent bigint REFERENCES tb_maker(pk_maker)); CREATE TABLE tb_part (id uuid, fk_maker bigint)"
    got = {(f.rule, f.severity) for f in v.key_pattern(parse_ddl(ddl))}
    assert got == {("foreign_key_name", "warning"), ("self_reference", "warning"), ("key_pattern", "error")}
    assert [f.rule for f in v.seed_files({"a.sql": "INSERT INTO x.t (a) VALUES (1) ON CONFLICT DO NOTHING;"}, "prep")] == ["schema_target"]
    good = "INSERT INTO tb_part (fk_maker) SELECT m.pk_maker FROM prep.p JOIN tb_maker m ON m.id = p.maker_id"
    assert v.resolvers(good) == [] and [f.severity for f in v.resolvers(good.replace("JOIN tb_maker", "JOIN other"))] == ["critical"]
    df = spark.createDataFrame([(1, "x", 1), (1, None, 9), (2, "y", None)], "id int, n string, m int")
    parent = spark.createDataFrame([(1,)], "k int")
    df.createOrReplaceTempView("lv")
    assert v.runtime(spark, {"lv": {"id": "int"}}) == [] and [f.rule for f in v.runtime(spark, {"lv": {"id": "bigint"}, "zz": {}})] == ["column_type", "missing_table"]
    assert [f.rule for f in v.execution(df, "lv", ["id"], ["n"], {"small": "m < 5"}, [("m", parent, "k")])] == ["not_null:n", "check:small", "duplicate_key", "orphans"]
    calls = []
    bad = lambda: calls.append(1) or [v.Finding(3, "x", v.CRITICAL, "")]
    assert len(v.run_levels([lambda: [], bad, bad])) == 1 and calls == [1]
    final = spark.createDataFrame([(7, "x")], "pk int, nat string")
    out, found = v.load_and_resolve(df.select("id", "n"), final, ("n", "nat"), "pk", "fk")
    assert {tuple(r) for r in out.collect()} == {(1, 7), (1, None), (2, None)} and found[0].message == "fk: 2 rows"


def test_text_checks():
    sql = "INSERT INTO a (x) SELECT y FROM b JOIN c ON true; UPDATE d SET x = 1 FROM e; DELETE FROM f WHERE g = 'from h'"
    assert v.lineage(sql) == [(1, "insert", "a", "target"), (1, "insert", "b", "source"), (1, "insert", "c", "source"), (2, "update", "d", "target"), (2, "update", "e", "source"), (3, "delete", "f", "target")]
    assert v.missing_tables(sql, {"a", "b", "c", "d", "f"}) == ["e"]
    assert v.tenant_isolation("INSERT INTO t (a) VALUES (1); INSERT INTO t (a, org) VALUES (1, 2)", {"t": "org"}) == [("t", "org")]
    raw = "CREATE TABLE a (x int); CREATE UNIQUE INDEX i ON a (x); DROP VIEW w; ALTER TABLE a ADD COLUMN y int; CREATE VIEW q AS SELECT 1; INSERT INTO a (x) VALUES (1)"
    assert [n for n, _ in v.idempotency(raw)] == ["create_table", "create_index", "drop_object", "add_column", "create_view", "insert"]
    assert v.idempotency(v.make_idempotent(raw)) == []
    rate, alive = v.kill_rate("CREATE TABLE a (x bigint NOT NULL UNIQUE)", lambda s: "NOT NULL" in s)
    assert 0 < rate < 1 and "drop_not_null" not in alive and v.kill_rate("SELECT 1", lambda s: True) == (1.0, [])


def test_snapshots(spark):
    of = lambda r: spark.createDataFrame(r, "kind string, name string, definition string")
    got = v.snapshot_compare(of([("table", "a", "1"), ("view", "b", "1")]), of([("table", "a", "2"), ("table", "c", "1")]))
    assert {tuple(r) for r in got.collect()} == {("table", "a", "modified"), ("view", "b", "removed"), ("table", "c", "added")}
    f = lambda r: spark.createDataFrame(r, "name string, arguments string")
    assert [tuple(r) for r in v.signature_drift(f([("f", "int")]), f([("f", "int"), ("f", "text")])).collect()] == [("f", "text")]
    df = spark.createDataFrame([(1, "x")], "id int, n string")
    assert v.facts_of(v.ddl_of(df, "t")) == [("t", "id", "integer", True), ("t", "n", "text", True)]
