import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"user_id", "rank", "item_id", "score", "source"}


def test_oracles_are_subset_of_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    if m.llm is None:
        assert not any(n.startswith("op") for n in q)
    if m.corpus_pipeline is None:
        assert "pipeline" not in q
