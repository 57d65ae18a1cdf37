"""SQL surface (section 2.14): the column helpers as SQL functions.

They are SQL-bodied temporary functions (``CREATE TEMPORARY FUNCTION ...
RETURN expr``); Catalyst inlines the body, so a SQL query using them plans
exactly like the DataFrame helpers - no Python worker involved.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = ("aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), "
        "CAST(0 AS DOUBLE), (acc, v) -> acc + v)")
_NORM_A = "sqrt(aggregate(transform(a, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v))"
_NORM_B = _NORM_A.replace("(a,", "(b,")

FUNCTIONS = {
    "vec_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    "vec_cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                   f"CASE WHEN {_NORM_A} > 0 AND {_NORM_B} > 0 THEN {_DOT} / ({_NORM_A} * {_NORM_B}) ELSE 0D END"),
    "vec_logistic_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
                         f"CASE WHEN b IS NOT NULL AND size(b) > 0 THEN 1D / (1D + exp(-{_DOT})) ELSE 0D END"),
    "fixed2": ("v DOUBLE", "STRING",
               "concat(CAST(floor(floor(v * 100D + 0.5D) / 100) AS STRING), '.', "
               "lpad(CAST(pmod(CAST(floor(v * 100D + 0.5D) AS BIGINT), 100) AS STRING), 2, '0'))"),
    "format_bytes": ("x BIGINT", "STRING",
                     "CASE WHEN x < 1024 THEN concat(fixed2(CAST(x AS DOUBLE)), ' B') "
                     "WHEN x < 1048576 THEN concat(fixed2(x / 1024D), ' KB') "
                     "WHEN x < 1073741824 THEN concat(fixed2(x / 1048576D), ' MB') "
                     "WHEN x < 1099511627776 THEN concat(fixed2(x / 1073741824D), ' GB') "
                     "ELSE concat(fixed2(x / 1099511627776D), ' TB') END"),
    "word_tokens": ("s STRING", "ARRAY<STRING>",
                    "coalesce(regexp_extract_all(lower(s), '[\\\\p{L}\\\\p{N}]+', 0), array())"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions in this session."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
