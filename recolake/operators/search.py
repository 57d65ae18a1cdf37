"""Text search over product documents for tables of queries.

Scoring contract (trap 25): BM25 (k1 = 1.2, b = 0.75) with exact document
lengths and collection-wide document frequencies; text fields use the word
analyzer (lower case, letter/digit runs), keyword fields match only when the
whole raw query equals the value. The document score is the best boosted
field score (best_fields, tie_breaker 0). With ``fuzzy`` each query token
also matches vocabulary terms within the AUTO edit distance (length <= 2:
exact, 3-5: 1, more: 2) with weight ``1 - dist / min(len)``; a token's
score on a document is its best expansion.

Retrieval is block-max over a stored index (``search_index``), fuzzy expansion a
pigeonhole join (``fuzzy``): no query x document rows before a block is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_folder
from . import search_index
from .fuzzy import auto_fuzziness, fuzzy_expansions  # noqa: F401
from .regex_index import regex_search  # noqa: F401

# (field, boost, kind) of the two reference searches
SEARCH_AND_RECOMMEND_FIELDS = (("title", 3.0, "text"), ("features", 2.0, "text"),
                               ("main_category", 2.0, "keyword"), ("description", 1.0, "text"),
                               ("store", 1.0, "keyword"))
SEARCH_PRODUCTS_FIELDS = (("title", 3.0, "text"), ("description", 1.0, "text"),
                          ("main_category", 2.0, "keyword"), ("features", 1.0, "text"))


def search(docs: DataFrame, queries: DataFrame, num: int = 10,
           fields=SEARCH_AND_RECOMMEND_FIELDS, fuzzy: bool = True) -> DataFrame:
    """T1/T2 for a table of queries: (query, rank, item_id, score), score > 0. Builds an index for
    these documents and asks it; a standing collection is indexed once (``search_index.build_index``)."""
    spark = docs.sparkSession
    path = search_index.build_index(docs, scratch_folder(spark, "index"), fields)
    return search_index.search_index(spark, path, queries, num, fields, fuzzy)
