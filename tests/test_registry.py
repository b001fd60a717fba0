"""Driver contract: every query has a callable; oracles only for queries."""

import importlib.util
import os


def _entry():
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_registry_shape():
    e = _entry()
    q, o = e.queries(), e.oracle_sql()
    assert len(q) >= 90
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_cheap_queries_run(spark, sf):
    q = _entry().queries()
    for name in ("user_features", "tag_vocabulary", "roadmap_cards", "dataset_profile"):
        assert q[name](spark, sf).count() > 0
