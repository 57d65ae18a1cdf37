"""Language identification by string kernels.

The kernel of two texts counts the distinct character n-grams (1 to 4, hashed per length) present in
both, divided by the geometric mean of the two self kernels (a blended-spectrum presence kernel). Nystrom features
against landmark texts and ridge regression, one against the rest, give the classifier. Since the
kernel is a product of presence vectors, landmarks, Nystrom map and ridge weights multiply into one matrix of
n-grams by languages: a batch of texts is scored by one product with it, the same numbers as by way of the landmarks.

Bounds (documented parameters): the classifier is fitted on at most SAMPLE labelled rows, the first per
language by a hash of the id, in equal shares over all languages, one row of each at least; LANDMARKS of them (more for many languages)
are landmarks. Prediction reads every whole text.

Defined results: a null text, or one without any letter, is ``und`` with score 0; an empty table gives an empty result; without any labelled row every
prediction is ``und``; rows with a null language are predicted but not learned from; repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, held_out

UNDETERMINED = "und"
SAMPLE = 2000
LANDMARKS = 256
MOST_LANDMARKS = 1024  # where there are more languages than half of that; two a language below
SALTS = 64  # a language's rows are cut in so many parts first
RIDGE = 1e-3
SHARPNESS = 6.0  # of the softmax that turns the margins into a score
LENGTHS = (1, 2, 3, 4)
BINS = (1 << 12, 1 << 15, 1 << 16, 1 << 16)
_OFFSETS = np.concatenate(([0], np.cumsum(BINS)))
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_LETTER = re.compile(r"[^\W\d_]")


def present(text: str) -> np.ndarray:
    """The hashed n-grams of a text (sorted positions). Case is folded; ASCII marks and digits become spaces."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where((c < 97) | ((c > 122) & (c < 128)), np.uint32(32), c)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    seen = np.zeros(_OFFSETS[-1], bool)
    for n, bins, at in zip(LENGTHS, BINS, _OFFSETS, strict=False):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h += (c[j:j + m] + np.uint32(1)) * _ODD[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        seen[at + (h >> np.uint32(32 - bins.bit_length() + 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class KernelModel:
    """languages and the matrix (n-grams x languages) that the landmarks and weights multiply into."""
    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    # with more languages than landmark features the first matrix leads to those, and this one on to the languages
    head: np.ndarray | None = None

    def margins(self, texts: list[str]) -> np.ndarray:
        """One product of the batch's (sparse) presence matrix with the weights."""
        grams = [present(t) for t in texts]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        rows = self.weights[np.concatenate(grams)]
        product = np.add.reduceat(rows, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        product = product / np.sqrt(sizes)[:, None]
        return (product if self.head is None else product @ self.head) + self.bias

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)]
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for a in range(0, len(known) if self.languages else 0, 64):
            part = known[a:a + 64]
            m = SHARPNESS * self.margins([texts[i] for i in part])
            p = np.exp(m - m.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(part, p.argmax(axis=1), p, strict=True):
                langs[i], scores[i] = self.languages[best], float(row[best])
        return langs, scores


def fit_sample(langs: list[str], grams: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """The classifier from sampled texts' n-grams. Landmarks are taken from the languages in turn."""
    names = tuple(sorted(set(langs)))
    if not names:
        return KernelModel((), np.zeros((0, 0)), np.zeros(0))
    turn = {x: 0 for x in names}
    order = []
    for i, x in enumerate(langs):
        order.append((turn[x], x, i))
        turn[x] += 1
    marks = [i for _, _, i in sorted(order)[:max(landmarks, min(2 * len(names), MOST_LANDMARKS))]]
    vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
    column = np.full(_OFFSETS[-1], -1, np.int64)
    column[vocabulary] = np.arange(len(vocabulary))

    def matrix(ids) -> np.ndarray:
        x = np.zeros((len(ids), len(vocabulary)), np.float32)
        for row, i in enumerate(ids):
            c = column[grams[i]]
            x[row, c[c >= 0]] = 1
            x[row] /= np.sqrt(len(grams[i]))
        return x
    z = matrix(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([(matrix(range(a, min(a + 256, len(langs)))) @ z.T) @ nystrom for a in range(0, len(langs), 256)])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    centre, level = phi.mean(axis=0), y.mean(axis=0)
    inner = (phi - centre).T @ (phi - centre) + ridge * len(langs) * np.eye(phi.shape[1])
    w = np.linalg.solve(inner, (phi - centre).T @ (y - level))
    direct = len(names) <= nystrom.shape[1]
    onto = z.T @ (nystrom @ w) if direct else z.T @ nystrom
    weights = np.zeros((_OFFSETS[-1], onto.shape[1]), np.float32)
    weights[vocabulary] = onto
    return KernelModel(names, weights, level - centre @ w, None if direct else w)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> KernelModel:
    """From a bounded sample of the rows that are not held out and have a language and a letter: ``sample`` rows, dealt evenly to all
    languages, and one row at least of each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    rows = rows.filter(~held_out())
    languages = rows.select("lang").distinct().count()
    if not languages:
        return fit_sample([], [])
    each = max(1, sample // languages)
    # the rows are chosen by id alone; only the chosen rows' texts are read on. A hot language is cut in parts first
    h = F.xxhash64("doc_id")
    some = rows.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.pmod(h, F.lit(SALTS)).alias("salt")).distinct()
    for keys in (["lang", "salt"], ["lang"]):
        first = Window.partitionBy(*keys).orderBy(h, "doc_id")
        some = some.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).drop("rank")
    chosen = some.select("doc_id", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, doc_id, text in zip(b["lang"], b["doc_id"], b["text"], strict=True):
                if _LETTER.search(text):
                    yield pd.DataFrame({"lang": [lang], "doc_id": [doc_id], "grams": [present(text).astype(np.int32).tobytes()]})
    # at most ``sample`` ids are broadcast, or one a language
    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])
    got = picked.mapInPandas(run, "lang string, doc_id long, grams binary").collect()
    got.sort(key=lambda r: (r.lang, r.doc_id))
    return fit_sample([r.lang for r in got], [np.frombuffer(r.grams, np.int32) for r in got])


def predicted(spark, model: KernelModel):
    """A function of a text column: struct(lang_pred, score)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            langs, scores = sent.value.predict(t.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
    return run


def language_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the labelled rows not held out."""
    language = predicted(docs.sparkSession, fit(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), language(F.col(text_col).cast("string")).alias("p"))
    return rows.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")


def identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The rows whose language can be told: not ``und``, and the score at least ``least``. Columns as they were."""
    language = predicted(docs.sparkSession, fit(docs, id_col, text_col, lang_col))
    name = free_name(docs, "_language")
    told = docs.withColumn(name, language(F.col(text_col).cast("string")))
    return told.filter((F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= least)).drop(name)
