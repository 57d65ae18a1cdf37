"""T4, P10: regular-expression search over a table of patterns, by way of trigrams.

A pattern's literal runs, those that every match must hold, give its required trigrams. Documents become postings of the trigrams of their
texts; a pattern meets the documents of its rarest trigram only, and what it meets is verified with the pattern itself. Patterns that
require nothing (``.*``, two letters) are verified against all documents, in passes of a bounded number. Texts are matched without regard to case,
each element of an array by itself.

Defined results: a pattern that does not compile is no match but a row of ``bad_patterns``; null patterns are left out; an empty
pattern matches every document with a text; null texts match nothing; equal patterns are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .popular import top_k_per_key

FIRST_PAIRS = 20  # times the wanted matches of a pattern are verified before the others
SCAN_PATTERNS = 1_000  # that require no trigram, verified together in one pass over the documents
_QUANTIFIER = re.compile(r"[?*+]|\{\d*,?\d*\}")


def required_literals(pattern: str) -> list[str]:
    """Runs of characters that every match holds; what is not certain is left out (groups, classes, options, optional characters)."""
    runs, run, i, depth = [], "", 0, 0

    def close() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""
    while i < len(pattern):
        c, literal = pattern[i], ""
        if c == "\\":
            n = pattern[i + 1:i + 2]
            literal, i = ("" if n.isalnum() else n), i + 2
        elif c == "[":
            i += 2 if pattern[i + 1:i + 2] == "]" else 3 if pattern[i + 1:i + 3] == "^]" else 1
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif c in "()":
            if pattern.startswith("(?", i) and pattern[i + 2:i + 3] not in (":", "=", "!", "<", "P", ">"):
                return []  # options change how the rest is read
            depth += 1 if c == "(" else -1
            close()
            i += 1
            if c == "(":
                continue
        elif c == "|":
            if not depth:
                return []
            i += 1
        else:
            literal, i = ("" if c in ".^$" else c), i + 1
        quantifier = _QUANTIFIER.match(pattern, i)
        if quantifier:
            i = quantifier.end()
            kept = quantifier[0][0] == "+"
            while pattern[i:i + 1] in ("?", "+") and pattern[i:i + 1]:
                i += 1
            if literal and kept and not depth:
                run += literal
            close()
        elif literal and not depth:
            run += literal
        else:
            close()
    close()
    return runs


def _folded(c: Column) -> Column:
    """One form for all letters that differ only in case."""
    # the dotted capital stands between, without it Spark would take upper away before lower
    return F.replace(F.lower(F.translate(F.upper(c), "İ", "I")), F.lit("ς"), F.lit("σ"))


def _grams(texts: Column) -> Column:
    """The distinct trigrams of an array of texts."""
    # the empty match before every three characters: one pass over a text
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), F.lit(1)))))


def _read(patterns: pd.Series) -> pd.DataFrame:
    out = []
    for p in patterns:
        try:
            re.compile(p, re.IGNORECASE)
            out.append((required_literals(p), None))
        except (re.error, OverflowError, RecursionError) as e:
            out.append(([], str(e)))
    return pd.DataFrame(out, columns=["literals", "error"])


def _patterns(queries: DataFrame, literal: bool) -> DataFrame:
    """query, pattern, literals, error."""
    q = queries.select("query").filter(F.col("query").isNotNull()).distinct()
    quoted = F.regexp_replace("query", r"([^\p{L}\p{N}\s])", r"\\$1") if literal else F.col("query")
    return q.withColumn("pattern", quoted).withColumn("r", F.pandas_udf(_read, "literals array<string>, error string")("pattern")).select("query", "pattern", "r.*")


def bad_patterns(queries: DataFrame) -> DataFrame:
    """query, error of the patterns that do not compile."""
    return _patterns(queries, False).filter("error is not null").select("query", "error")


def _texts(docs: DataFrame, fields: tuple[str, ...]) -> Column:
    kinds = dict(docs.dtypes)
    parts = [F.col(f) if kinds[f].startswith("array") else F.array(f) for f in fields if f in kinds]
    return F.array_compact(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))


def regex_matches(docs: DataFrame, queries: DataFrame, fields: tuple[str, ...] = ("title", "description", "features"),
                  literal: bool = False, report: dict | None = None, first: int | None = None) -> DataFrame:
    """(query, item_id) of all matches. ``literal``: queries are quoted text. ``report`` receives how many pairs were verified by way of trigrams.

    ``first``: only the matches with a pattern's ``first`` smallest ids are certain to be among the rows. The pairs of smallest ids are then verified
    before the others, and patterns that have enough matches among them are done; of the rest every pair is verified."""
    spark = docs.sparkSession
    path = scratch_folder(spark, "regex")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")
    texts = kept(docs.select("item_id", _texts(docs, fields).alias("texts")), "texts")
    asked = kept(_patterns(queries, literal).filter("error is null"), "patterns")
    needed = kept(asked.select("query", F.explode(_grams(F.transform("literals", _folded))).alias("gram")), "grams")
    # only trigrams that some pattern requires become postings
    postings = kept(texts.select("item_id", F.explode(_grams(F.transform("texts", _folded))).alias("gram"))
                    .join(needed.select("gram").distinct(), "gram", "left_semi"), "postings")
    # of every pattern the rarest trigram; one that no document has ends the search for its pattern
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = needed.join(counts, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    pairs = kept(rarest.select("query", F.col("g.gram").alias("gram")).join(postings, "gram").select("query", "item_id"), "pairs")
    @F.pandas_udf("array<string>")
    def held(asked: pd.Series, texts: pd.Series) -> pd.Series:
        found = {q["pattern"]: re.compile(q["pattern"], re.IGNORECASE) for own in asked for q in own}
        return pd.Series([[q["query"] for q in own if any(found[q["pattern"]].search(t) for t in ts)] for own, ts in zip(asked, texts, strict=True)], dtype=object)
    # a text goes once with its patterns, a bounded number of them, not once with each
    spread = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-asked.count() // SCAN_PATTERNS))))

    def verified(some: DataFrame) -> DataFrame:
        of_doc = (some.join(asked.select("query", "pattern"), "query").groupBy("item_id", spread.alias("_s"))
                  .agg(F.collect_list(F.struct("query", "pattern")).alias("_asked")))
        return of_doc.join(texts, "item_id").select(F.explode(held("_asked", "texts")).alias("query"), "item_id")
    id_type, early, late = dict(texts.dtypes)["item_id"], None, pairs
    if first is not None:
        reached = (top_k_per_key(pairs.filter(F.col("item_id").isNotNull()), ["query"], [F.col("item_id")], FIRST_PAIRS * first)
                   .groupBy("query").agg(F.max("item_id").alias("_reached")))
        reached = kept(reached, "reached")
        # all rows of an id are on the same side
        early = pairs.join(reached, "query").filter(F.col("item_id") <= F.col("_reached")).select("query", "item_id")
        sure = kept(verified(early), "sure")
        done = sure.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= first).select("query")
        late = pairs.join(done, "query", "left_anti").join(reached, "query").filter(F.col("item_id") > F.col("_reached")).select("query", "item_id")
    if report is not None:
        report.update(verified=late.count() + (early.count() if first is not None else 0))
    met = verified(late) if first is None else sure.unionByName(verified(late))

    free = asked.join(needed.select("query").distinct(), "query", "left_anti").select("query", "pattern")
    passes = -(-free.count() // SCAN_PATTERNS)
    for k in range(passes):
        # a bounded number of patterns goes to every task
        own = [(r.query, r.pattern) for r in free.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == k).collect()]

        def scan(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            found = [(q, re.compile(p, re.IGNORECASE)) for q, p in own]
            for batch in batches:
                ids, at, out = batch["item_id"], [], []
                for i, texts in enumerate(batch["texts"].to_pylist()):
                    hits = [q for q, p in found if any(p.search(t) for t in texts)]
                    out += hits
                    at += [i] * len(hits)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), ids.take(pa.array(at, pa.int64()))], names=["query", "item_id"])
        met = met.unionByName(texts.mapInArrow(scan, f"query string, item_id {id_type}"))
    return met


def regex_search(docs: DataFrame, queries: DataFrame, num: int = 10, literal: bool = True, report: dict | None = None) -> DataFrame:
    """The first ``num`` matches of each query by item id: (query, rank, item_id, score = 1.0), over title, description and features."""
    ranked = top_k_per_key(regex_matches(docs, queries, literal=literal, report=report, first=num), ["query"], [F.col("item_id")], num)
    return ranked.select("query", "rank", "item_id", F.lit(1.0).alias("score"))
