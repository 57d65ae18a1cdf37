"""Registered queries against their SQL or brute force on whole small tables, and the pipeline stage by stage."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from recolake.llm import mixing, queries
from recolake.llm.common import documents, stored

from .conftest import rows_of
from .test_dedup import brute_components, brute_lines

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    cols = ", ".join(sorted(got.columns))
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(rows_of(got.select(*sorted(got.columns))), key=repr) == sorted(want, key=repr)


def test_neighbours_query_recall(spark, con):
    ids, x = zip(*con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall(), strict=True)
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.op2_nearest_neighbours(spark, SMALL).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[at]
            s[at] = -2
            hits.append(len({ids[j] for j in np.argsort(-s)[:5]} & got[i]) / 5)
    assert np.mean(hits) >= 0.9


def test_classifier_queries_on_held_out_rows(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r.lang_pred == lang[r.doc_id] for r in queries.op10_language_id(spark, SMALL).collect() if r.held_out]
    assert np.mean(got) > 0.95
    label = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    got = [r.predicted == label[r.doc_id] for r in queries.op8_quality_classifier(spark, SMALL).collect() if r.held_out and r.doc_id in label]
    assert np.mean(got) > 0.9


def test_pipeline_stages_against_brute_force(spark, monkeypatch):
    docs = documents(spark, SMALL)
    columns = docs.columns
    (_, lang), (_, lines), (_, near), (_, mix), (_, code) = corpus_pipeline.STAGES
    one = stored(lang(spark, docs, SMALL), "t")
    assert one.columns == columns and one.count() > 0.95 * docs.count()
    two = stored(lines(spark, one, SMALL), "t")
    before = rows_of(one.select("doc_id", "text"))
    assert two.columns == columns and two.dtypes == docs.dtypes
    assert [(i, h) for i, _, _, h in brute_lines(before)] == sorted(
        rows_of(two.selectExpr("doc_id", "sha2(cast(text as binary), 256)")))
    three = stored(near(spark, two, SMALL), "t")
    want = {c if n else i for i, n, c in brute_components(rows_of(two.select("doc_id", "text")))}
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(want)
    four = stored(mix(spark, three, SMALL), "t")
    sizes, largest = {}, {}
    for r in three.collect():
        n = len(r.text.split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    taken = dict.fromkeys(sizes, 0)
    for r in four.collect():
        taken[r.source] += len(r.text.split())
    quota = mixing.quotas(sizes)
    # ten documents a source here: whole documents come as near as one of them
    assert four.columns == columns and all(abs(taken[x] - quota[x]) <= largest[x] for x in quota)
    five = code(spark, four, SMALL)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in four.collect()}
    got = five.collect()
    assert len(got) == four.count() and all(r.ids == library.encode(texts[r.doc_id]) and r.text == library.decode(r.ids) for r in got)
