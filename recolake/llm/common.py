"""Helpers shared by the corpus operators: scratch tables in the cluster's shared folder and
vectorised word and shingle hashing of text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolake.session import ensure_checkpoint_dir

# fixed values: the ASCII white space that separates words and is stripped from lines
WHITESPACE = "\x20\x09\x0a\x0b\x0c\x0d"
# Spark SQL pattern of one word
WORD = r"[^\x20\x09-\x0D]+"

# text handled at once by the vectorised hashing below (bytes); a longer text is a batch of its own
BATCH_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id="doc_id"):
    """The rows kept from training: crc32 of the id's decimal text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive texts with about ``limit`` characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all texts in order, and the offset of each
    text's first word (one entry more than texts). No loop over words: byte prefix sums in base p."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts),
                          np.int64, len(texts))
    b = np.frombuffer(raw, np.uint8).copy()
    b[(b >= 65) & (b <= 90)] += 32
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(_BASE_INVERSE, len(b) + 1)[start]
    h = mix64(h + (end - start).astype(np.uint64) * _STEP[7])
    first_byte = np.concatenate(([0], np.cumsum(lengths + 1)))
    return h, np.searchsorted(start, first_byte)


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles; fewer words: the whole
    sequence as one; no word: empty."""
    out = []
    for a, b in text_batches(texts):
        h, offset = word_hashes(texts[a:b])
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j:j + n] * _STEP[j]
        s = mix64(s)
        for x, y in zip(offset[:-1], offset[1:], strict=True):
            if y - x >= k:
                out.append(np.unique(s[x:y - k + 1]))
            elif y > x:
                whole = (h[x:y] * _STEP[:y - x]).sum(dtype=np.uint64, keepdims=True) + _STEP[k + y - x:k + y - x + 1]
                out.append(mix64(whole))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
