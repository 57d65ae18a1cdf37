"""Token files and SentencePiece coding: round trips, and equality with the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from recolake.llm import sentencepiece_codec, simple8b, token_output
from recolake.llm.sentencepiece_codec import MARK, Pieces

from .conftest import rows_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a\n\nb \n c", "tab\t x", "nbsp  x", "<|endoftext|> y", "日本 語", "a\x1c b\x85 c", "é" * 70, "\x00 z",
       "it's 12's  99", "word " * 3000, "x" * 20_000, "\U0001F600 ok"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 3), st.integers(0, 60_000)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()


def test_simple8b_packs_and_escapes():
    assert len(simple8b.encode(np.ones(60))) == 1
    assert len(simple8b.encode(np.full(9, 30_000))) == 3
    assert simple8b.encode(np.array([2**63], np.uint64)).tolist() == [0, 2**63]
    with pytest.raises(ValueError):
        simple8b.decode(np.array([15 << 60], np.uint64), 1)
    with pytest.raises(ValueError):
        simple8b.decode(np.array([1 << 60], np.uint64), 61)


def test_pieces_equal_the_library_on_whole_texts():
    encoder, r = token_output.PieceEncoder(BPE), random.Random(2)
    texts = ODD + ["".join(r.choices("ab1.'s  \n\t\r\x1c\x85 　é日", k=r.randrange(14))) for _ in range(4000)]
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [v.tolist() for v in encoder.encode(texts)] == whole


def test_texts_are_cut_at_words_and_marks():
    """A word is learned once, not once for every mark that may follow it."""
    encoder = token_output.PieceEncoder(BPE)
    words, marks = [f"w{chr(97 + i)}é" for i in range(20)], [",&&&", "!!", ".\nAnd", "?", "###", "'s"]
    texts = [f"first {w}{m} last" for w in words for m in marks]
    assert [v.tolist() for v in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert {f" {w}".encode() for w in words} <= encoder.known.keys()
    assert len(encoder.known) <= 20 + 8 + 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"ab'slvret.,!12 \n\t\r\x0b\x1c\x85\xa0\u200b\u3000\u2028\u180eéß×²日ı\u0301\x00Ā\U0001F600"]), max_size=14), max_size=8))
def test_cuts_never_change_the_ids(texts):
    encoder = token_output._encoder(BPE)
    assert [v.tolist() for v in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_columns_with_ends_and_slices(monkeypatch):
    monkeypatch.setattr(token_output, "PART_BYTES", 9)
    encoder = token_output.PieceEncoder(BPE)
    batch = pa.record_batch({"doc_id": list(range(len(ODD) + 2)), "text": ["", *ODD, ""]})
    got = []
    for part in token_output._parts(batch.slice(1)):
        assert part.num_rows == 1 or part.column(1).nbytes < 200
        ids, counts = encoder.encode_column(part.column(1), 2)
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [v.tolist() for v in got] == [[*e.ids, 2] for e in encoder.tokenizer.encode_batch([*ODD, ""], add_special_tokens=False)]
    assert [len(v) for v in encoder.encode(["", ""])] == [0, 0] and encoder.encode([]) == []


def test_pieces_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_CHARS", 200)
    encoder, r = token_output.PieceEncoder(BPE), random.Random(4)
    for _ in range(60):
        texts = [" ".join("".join(r.choices("abcde", k=r.randrange(1, 14))) for _ in range(8)) for _ in range(3)]
        assert [v.tolist() for v in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.size < 2000


def test_token_files(spark, make, tmp_path, monkeypatch):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD)] + [(900 + i, f"text {i} " * i) for i in range(200)] + [(3, "tie b"), (3, "tie a"),
                                                                                                           (None, "no id"), (60, None)]
    docs = make(rows).withColumnsRenamed({"lang": "shard", "source": "words"})
    token_output.write_tokens(docs, str(tmp_path), BPE)
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(rows_of(token_output.token_digests(spark, str(tmp_path))), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    assert [r.ids for r in token_output.read_tokens(spark, str(tmp_path)).orderBy("start").collect()] == [w[4] for w in want]


def test_token_blocks_end_after_enough_ids(spark, make, tmp_path, monkeypatch):
    token_output.write_tokens(make([(i, "some words here " * 30_000) for i in range(3)]), str(tmp_path), BPE)
    blocks = token_output.read_blocks(spark, str(tmp_path)).collect()
    assert len(blocks) == 3 and all(len(b.doc_ids) == 1 for b in blocks)


def test_token_files_of_an_empty_table(spark, make, tmp_path):
    token_output.write_tokens(make([]), str(tmp_path), BPE)
    assert rows_of(token_output.token_digests(spark, str(tmp_path))) == []


def test_pieces_equal_sentencepiece():
    pieces, library, r = Pieces.load(MODEL), SentencePieceProcessor(model_file=MODEL), random.Random(3)
    texts = ODD + ["<s>", "</s><unk>", "<0x0A>", "a" * 300, "ab" * 200, " " * 99, f"x{MARK}y", "퟿"]
    texts += ["".join(r.choices([*"aabbeettnniisshh. \n\t日é0127<>", MARK, "the", " in", "ing", "   "], k=r.randrange(30))) for _ in range(3000)]
    ids = pieces.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [pieces.decode(x) for x in ids] == [library.decode(x) for x in ids]


def brute_unigram(p: Pieces, word: str) -> float:
    best = [0.0] + [-1e9] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            if word[s:e] in p.id_of:
                best[e] = max(best[e], best[s] + p.scores[p.id_of[word[s:e]]])
        if word[e - 1] not in p.id_of:
            best[e] = max(best[e], best[e - 1] + p.worst)
    return best[-1]


def test_unigram_viterbi_and_shared_prefixes():
    r = random.Random(1)
    vocabulary = ["<unk>", "a", "b", "c", "ab", "abc", "bca", "cab", "aab", "bb"]
    p = Pieces(vocabulary, [0.0] + [-r.uniform(1, 6) for _ in vocabulary[1:]], "unigram", plain=list(range(1, 10)))
    words = ["".join(r.choices("abcx", k=r.randrange(1, 12))) for _ in range(300)]
    together = p.segment_all(list(set(words)))
    for w in words:
        ids = np.frombuffer(together[w], np.int32).tolist()
        assert "".join("" if i == 0 else vocabulary[i] for i in ids) == w.replace("x", "")
        score = sum(p.scores[i] for i in ids if i) + p.worst * w.count("x")
        assert abs(score - brute_unigram(p, w)) < 1e-9
        assert p.segment_all([w])[w] == together[w]


def test_neighbours_equal_merging_by_definition():
    p, r = Pieces.load(MODEL), random.Random(5)
    ids = [i for i in p.id_of.values() if p.pieces[i].isascii()]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(4000)]
    for _ in range(300):  # the neighbours in real words, and pieces cut elsewhere
        whole = p.pieces[r.choice(ids)] + p.pieces[r.choice(ids)]
        pairs += [(p.id_of[whole[:k]], p.id_of[whole[k:]]) for k in range(1, len(whole)) if whole[:k] in p.id_of and whole[k:] in p.id_of]
    for a, b in pairs:
        x, y = p.pieces[a], p.pieces[b]
        assert p._neighbours(a, b) == (p.merged(x + y) == [x, y]), (x, y)


def test_model_kind_is_read_from_the_file():
    def message(kind):
        trainer = b"\x0a\x01x" + (b"" if kind is None else bytes([3 << 3, kind]))
        return b"\x0a\x03abc" + bytes([2 << 3 | 2, len(trainer)]) + trainer
    assert Pieces.load(MODEL).kind == "bpe"
    assert [sentencepiece_codec.model_kind(message(k)) for k in (None, 1, 2)] == ["unigram", "unigram", "bpe"]
    with pytest.raises(ValueError, match="type 3"):
        sentencepiece_codec.model_kind(message(3))


def test_words_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 2000)
    monkeypatch.setattr(sentencepiece_codec, "CACHE_PAIRS", 20)
    p, library, r = Pieces.load(MODEL), SentencePieceProcessor(model_file=MODEL), random.Random(9)
    for _ in range(60):
        texts = [" ".join("".join(r.choices("abcde", k=3)) for _ in range(8)) for _ in range(3)]
        assert [x.tolist() for x in p.encode(texts)] == library.encode(texts)
    assert len(p.known) < 60 and len(p._fits) <= 21


def test_codec_columns(make):
    docs = make([(i, t) for i, t in enumerate(ODD)] + [(99, None), (99, None)]).withColumnsRenamed({"lang": "_coded"})
    library = SentencePieceProcessor(model_file=MODEL)
    coded = sentencepiece_codec.encoded(docs, MODEL)
    assert coded.columns == [*docs.columns, "ids"]
    for r in sentencepiece_codec.decoded(coded, MODEL, text_name="back").collect():
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.back == (None if r.text is None else library.decode(r.ids))
    both = sentencepiece_codec.coded(docs, MODEL)
    assert both.columns == [*docs.columns, "ids"]
    for r in both.collect():
        assert r.ids == (None if r.doc_id == 99 else library.encode(ODD[r.doc_id]))
        assert r.text == (None if r.doc_id == 99 else library.decode(r.ids))
    for r in sentencepiece_codec.round_trip(docs, MODEL).collect():
        if r.doc_id == 99:
            assert (r.n_pieces, r.ids, r.decoded_sha256, r.lossless) == (0, None, None, None)
        else:
            assert r.ids == library.encode(ODD[r.doc_id]) and r.n_pieces == len(r.ids) and r.lossless
    assert rows_of(sentencepiece_codec.round_trip(make([]), MODEL)) == []
