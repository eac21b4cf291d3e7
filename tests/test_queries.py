import pytest

from millrace.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_without_llm(spark, sf, monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    found = importlib.util.find_spec
    monkeypatch.setattr(e.importlib.util, "find_spec", lambda n: None if n in ("millrace.llm", "corpus_pipeline") else found(n))
    assert not [n for n in e.queries() if n.startswith("op") and n[2].isdigit()] and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_pushdown_and_pruning(spark, sf, capsys):
    QUERIES["copy_with_transform"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,25.0)" in plan and "l_comment" not in plan and "Python" not in plan
