import os

from recolake.operators import search
from recolake.plans import queries_search
from recolake.sources import tables as T

from .conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_searches_cover_all_their_fields(spark):
    """The coverage table may call T1 and T2 covered only while their queries search every field of the two searches."""
    rows = {x.split(" | ")[0].strip("| "): x for x in open(os.path.join(ROOT, "COVERAGE.md")) if x.startswith("| T")}
    assert all("partial" not in rows[i] for i in ("T1", "T2"))
    held = set(T.described_products(spark, SMALL).columns)
    assert {f for f, _, _ in (*search.SEARCH_AND_RECOMMEND_FIELDS, *search.SEARCH_PRODUCTS_FIELDS)} <= held
    assert not hasattr(queries_search, "_held")
