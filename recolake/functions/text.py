"""String helpers (F5, F10, F11, F13-F19, P14, T5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Word tokens: runs of letters or digits, after lower-casing (text analyzer).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_text(ts) -> Column:
    """Timestamp as fixed-width text (microseconds), for engine-neutral output."""
    return F.date_format(_c(ts), TS_TEXT_FORMAT)


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), ISO_FORMAT)


def tokens(text) -> Column:
    """Analyzer: lower case, then word tokens (array<string>, empty for null)."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0),
                      F.array().cast("array<string>"))


def fixed2(x) -> Column:
    """Non-negative number as text with 2 decimals, half-up on ``x * 100``.

    Built from integer arithmetic (not a printf), so every engine that does
    IEEE double arithmetic produces the same text, ties included."""
    cents = F.floor(_c(x).cast("double") * 100.0 + 0.5).cast("bigint")
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def format_bytes(size) -> Column:
    """B / KB / MB / GB / TB with 2 decimals, 1024 steps."""
    s = _c(size).cast("double")
    k = 1024.0

    def unit(v, u):
        return F.concat(fixed2(v), F.lit(" " + u))
    return (F.when(s < k, unit(s, "B"))
            .when(s < k ** 2, unit(s / k, "KB"))
            .when(s < k ** 3, unit(s / k ** 2, "MB"))
            .when(s < k ** 4, unit(s / k ** 3, "GB"))
            .otherwise(unit(s / k ** 4, "TB")))


def percent_text(num, den) -> Column:
    """'x.xx%' with a guarded denominator; 'N/A' when the denominator is 0 or null."""
    d = _c(den).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit("N/A")).otherwise(
        F.concat(fixed2(_c(num).cast("double") / d * 100.0), F.lit("%")))


def username(position, user_id) -> Column:
    """``user_%03d_<first 8 chars of the id>``."""
    return F.format_string("user_%03d_%s", _c(position).cast("bigint"),
                           F.substring(_c(user_id).cast("string"), 1, 8))


def user_id_from_time(ts) -> Column:
    return F.concat(F.lit("USER_"), F.unix_timestamp(_c(ts)).cast("string"))


def key_part(key, i: int) -> Column:
    """0-based i-th ``:`` part of a key (null when absent)."""
    return F.try_element_at(F.split(_c(key), ":"), F.lit(i + 1))


def glob_to_like(pattern: str) -> str:
    """Redis-style glob (``*``, ``?``) to a SQL LIKE pattern."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        elif ch in "%_\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def stable_hash(text) -> Column:
    """Process-independent query hash (the reference's per-process ``hash``)."""
    return F.xxhash64(_c(text))
