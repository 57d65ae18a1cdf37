"""Vocabulary terms within the AUTO edit distance of query terms, by a pigeonhole join.

A vocabulary term is cut into d + 1 even segments. If a query term is within d edits of it, one segment stands in the query term
unchanged and at most d places aside. So terms meet on (distance, length, segment number, segment): d + 1 keys for a vocabulary term
and, for a query term, one for each length, segment and place - a number that does not depend on the term's length.
Levenshtein confirms the pairs, so only those that share a segment are ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_EDITS = 2


def auto_fuzziness(term: Column) -> Column:
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _starts(length: Column, edits: int) -> list[Column]:
    """Where the segments of a term of some length start (from 0), and its end."""
    return [F.floor(length * i / (edits + 1)).cast("int") for i in range(edits + 2)]


def vocabulary_keys(vocabulary: DataFrame) -> DataFrame:
    """term, edits, size, part, segment: the keys of every term, for each number of edits that may be asked."""
    keys = []
    n = F.length("term")
    for d in range(1, MOST_EDITS + 1):
        at = _starts(n, d)
        keys += [F.when(n > d, F.struct(F.lit(d).alias("edits"), n.alias("size"), F.lit(i).alias("part"),
                                        F.col("term").substr(at[i] + 1, at[i + 1] - at[i]).alias("segment"))) for i in range(d + 1)]
    return vocabulary.select("term", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("term", "k.*")


def query_keys(terms: DataFrame) -> DataFrame:
    """qterm, edits, size, part, segment: what a near term's segments can be."""
    q = terms.withColumn("edits", auto_fuzziness(F.col("qterm"))).filter("edits > 0")
    n = F.length("qterm")
    q = q.withColumn("size", F.explode(F.sequence(n - F.col("edits"), n + F.col("edits")))).filter("size > edits")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start = F.floor(F.col("size") * F.col("part") / (F.col("edits") + 1)).cast("int")
    width = F.floor(F.col("size") * (F.col("part") + 1) / (F.col("edits") + 1)).cast("int") - start
    q = q.withColumns({"start": start, "width": width})
    low, high = F.greatest(F.lit(0), F.col("start") - F.col("edits")), F.least(n - F.col("width"), F.col("start") + F.col("edits"))
    q = q.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    return q.select("qterm", "edits", "size", "part", F.col("qterm").substr(F.col("at") + 1, F.col("width")).alias("segment")).distinct()


def fuzzy_expansions(query_terms: DataFrame, vocab: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(qterm, term, dist) with dist <= AUTO(qterm); exact only when not fuzzy."""
    asked = query_terms.select("qterm").distinct()
    same = (asked.join(vocab.select(F.col("term").alias("qterm")), "qterm")
            .select("qterm", F.col("qterm").alias("term"), F.lit(0).alias("dist")))
    if not fuzzy:
        return same
    pairs = (query_keys(asked).join(vocabulary_keys(vocab), ["edits", "size", "part", "segment"])
             .filter(F.col("qterm") != F.col("term")).select("qterm", "term", "edits").distinct())
    near = pairs.withColumn("dist", F.levenshtein("qterm", "term", MOST_EDITS)).filter("dist between 0 and edits")
    return same.unionByName(near.select("qterm", "term", "dist"))
