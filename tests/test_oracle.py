"""Every registered query with an oracle equals DuckDB on the sf0.001 fixture."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import duck, key, norm  # noqa: E402
from recolake.plans.catalog import load_all  # noqa: E402

from .conftest import SMALL  # noqa: E402

REG = load_all()
NAMES = sorted(n for n, q in REG.items() if q.oracle)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    q = REG[name]
    sdf = q.fn(spark, SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=key)
    res = con.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    pos = [dcols.index(c) for c in cols]
    drows = sorted((tuple(norm(r[i]) for i in pos) for r in res.fetchall()), key=key)
    assert srows == drows


def test_trained_models_predict_their_ratings(spark):
    """The queries that depend on the trained model's numbers: no SQL, but bounds that a model must meet."""
    names = sorted(n for n, q in REG.items() if q.oracle is None)
    assert names == ["als_fit_metrics", "als_recommendations", "als_variant_b_metrics"]
    for name in ("als_fit_metrics", "als_variant_b_metrics"):
        m = REG[name].fn(spark, SMALL).first()
        assert m.n_test > 500 and 0 < m.mae <= m.rmse < 4
    recs = REG["als_recommendations"].fn(spark, SMALL).collect()
    by_user = {}
    for r in sorted(recs, key=lambda r: r["rank"]):
        by_user.setdefault(r.user_id, []).append(r.score)
    assert len(by_user) > 100 and all(s == sorted(s, reverse=True) for s in by_user.values())
