"""Token ids in files: Simple-8b blocks in Parquet, in ascending order of documents.

A file set is a folder with two tables written by one job. A row of ``blocks`` is one block: its shard and number, the
documents in it with their counts, the ids before it in its shard (the block's offset), and the words that
``simple8b`` packs. A block holds whole documents and ends after BLOCK_IDS ids. Shards are consecutive ranges of
documents, so a shard's offset is the sum of the shards before it. Any block is decoded on its own.

Encoding is the tokenizers library's. Its byte-level pretokenizer ends a piece at every change between letters, digits, marks and white
space of ASCII but for a space before a word and an apostrophe before letters, so texts are cut there, many texts at once, and each
distinct piece is encoded by the library once per worker. Next to other characters a text is cut only where that is certain.

Defined results: a null text counts as empty and has the end id alone; null ids sort first; equal ids sort by text;
special tokens' strings in a text are encoded as ordinary text; an empty table writes no block; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b

BLOCK_IDS = 1 << 16
CACHE_CHARS = 5 << 20  # of the pieces that a worker remembers, about 150 MB with their ids
SHORT = 9  # pieces up to this length, the common ones, are kept when the memory is full
PART_BYTES = 2 << 20  # of the texts that are cut at once
END_ID = 2

_BLOCKS = "shard int, block int, before long, doc_ids array<long>, counts array<long>, words binary"

# a piece that the pretokenizer leaves whole: its bytes stand for themselves but for the space, or it has letters of Latin-1
_PLAIN = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_JOINED = 100

# what a byte belongs to: letter, digit, mark, apostrophe, space, other white space; a character that is no white space; one that may be
_L, _D, _P, _A, _S, _W, _N, _X = range(8)
_CLASS = np.full(256, _N, np.uint8)
_CLASS[:128] = _P
for _letters in (range(65, 91), range(97, 123)):
    _CLASS[_letters] = _L
_CLASS[48:58] = _D
_CLASS[39] = _A
_CLASS[32] = _S
_CLASS[9:14] = _W
_CLASS[28:32] = _X
# by the classes before and after a place: whether a piece ends there; whether it does if no white space follows
_CUT = np.zeros((8, 8), bool)
for _before, _after in ((_L, (_D, _P, _A, _S, _W)), (_D, (_L, _P, _A, _S, _W)), (_P, (_L, _D, _S, _W)), (_A, (_D, _S, _W)), (_N, (_S, _W)),
                        (_W, (_L, _D, _P, _A, _N))):
    _CUT[_before, _after] = True
_RUN = np.zeros((8, 8), bool)
_RUN[[[_S], [_W], [_X]], [_S, _W]] = True
_CUT, _RUN = _CUT.ravel(), _RUN.ravel()
_BLACK = np.isin(np.arange(8), (_L, _D, _P, _A, _N))


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte of UTF-8 texts."""
    found = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[np.isin(data[lead], (0xC2, 0xC3, 0xE1, 0xE2, 0xE3))]
    first, second = data[lead], data[lead + 1]
    for mine, kind in (((first == 0xC3) & (second != 0x97) & (second != 0xB7), _L), ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)), _X)):
        found[lead[mine]] = found[lead[mine] + 1] = kind
    lead = lead[first >= 0xE1]
    first, second, third = data[lead], data[lead + 1], data[lead + 2]
    white = (((first == 0xE1) & (((second == 0x9A) & (third == 0x80)) | ((second == 0xA0) & (third == 0x8E))))
             | ((first == 0xE2) & (((second == 0x80) & ((third <= 0x8F) | ((third >= 0xA8) & (third <= 0xAF)))) | ((second == 0x81) & (third >= 0x9F))))
             | ((first == 0xE3) & (second == 0x80) & (third == 0x80)))
    for k in range(3):
        found[lead[white] + k] = _X
    return found


def _piece_offsets(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts between ``bounds`` begin, and the end of the last."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n > 1:
        kind = _classes(data)
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        begins[1:n] = _CUT[pair]
        # the last one of several white spaces begins a piece if more text follows
        run = np.flatnonzero(_RUN[pair]) + 1
        run = run[run + 1 < n]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begins[run[_BLACK[kind[run + 1]] & ~edge[run + 1]]] = True
    begins[bounds] = True
    return np.flatnonzero(begins)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class PieceEncoder:
    """The ids of texts by the tokenizer in a file, with a memory of pieces of bounded size."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        # the same model without pretokenizer, for words already in byte letters
        model = json.loads(self.tokenizer.to_str())
        model |= {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(model))
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in encoded]

    def _learn_words(self, pieces: list[bytes], plain: bool) -> None:
        """Pieces that the pretokenizer leaves whole, many in one call; token lengths tell them apart."""
        groups = [pieces[a:a + _JOINED] for a in range(0, len(pieces), _JOINED)]
        texts = [b"\xff".join(g) for g in groups]  # no byte of UTF-8
        if plain:
            mapped = [t.replace(b" ", chr(self.letters[32]).encode()).replace(b"\xff", b" ").decode() for t in texts]
        else:
            letters = self.letters | {255: " "}
            mapped = [t.decode("latin-1").translate(letters) for t in texts]
        for group, e in zip(groups, self.words.encode_batch_fast(mapped, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))) + 1
            raw, a = ids.tobytes(), 0
            for p, b in zip(group, (4 * ends).tolist(), strict=True):
                self.known[p] = raw[a:b]
                a = b

    def _learn(self, pieces: list[bytes]) -> None:
        plain, latin, other = [], [], []
        for p in pieces:
            (plain if _PLAIN.fullmatch(p) else latin if _LATIN.fullmatch(p) else other).append(p)
        for a in range(0, len(other), 4000):
            part = other[a:a + 4000]
            self.known.update(zip(part, self._whole([p.decode() for p in part]), strict=True))
        for words in (plain, latin):
            for a in range(0, len(words), 8000):
                self._learn_words(words[a:a + 8000], words is plain)
        self.size += sum(map(len, pieces))

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's followed by ``end_id``, and their number for each text."""
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[bounds[0]:bounds[-1]] if held else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        offsets = _piece_offsets(data, bounds)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.size > CACHE_CHARS:
            self.known = {p: ids for p, ids in self.known.items() if len(p) <= SHORT}
            self.size = sum(map(len, self.known))
            if 2 * self.size > CACHE_CHARS:
                self.known, self.size = {}, 0
        self._learn([p for p in distinct if p not in self.known])
        known = list(map(self.known.__getitem__, distinct))
        ends = np.searchsorted(offsets, bounds)  # pieces before each text, and all
        if end_id is not None:
            known.append(np.uint32(end_id).tobytes())
            codes = np.insert(codes, ends[1:], len(distinct))
            ends = ends + np.arange(len(ends))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, at = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes
        many = sizes[codes]
        before = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(at[codes] - before[:-1], many) + np.arange(before[-1])]
        return ids, np.diff(before[ends])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1])


_encoders: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs. A task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PART_BYTES of text, one row at least."""
    begin = 0
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PART_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every text and write the blocks below ``path``."""
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer_file), TaskContext.get().partitionId()
        ids, counts, values, held, block, before = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, counts, values, held, block, before
            v = np.concatenate(values)
            words = simple8b.encode(v).astype("<u8").tobytes()
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([words], pa.binary())],
                names=["shard", "block", "before", "doc_ids", "counts", "words"])
            ids, counts, values, block, before, held = [], [], [], block + 1, before + held, 0
            return row
        for b in batches:
            for part in _parts(b):
                v, sizes = encoder.encode_column(part.column(1), end_id)
                at = 0
                for doc_id, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                    ids.append(doc_id)
                    counts.append(n)
                    values.append(v[at:at + n])
                    at += n
                    held += n
                    if held >= BLOCK_IDS:
                        yield flush()
        if ids:
            yield flush()
    rows.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path.rstrip('/')}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the ids before them in the whole file set."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path.rstrip('/')}/blocks")
    total = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    at, shards = 0, []
    # one number for each shard, that is for each task that wrote
    for r in total.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        shards.append((r.shard, at))
        at += r.n
    offsets = spark.createDataFrame(shards, "shard int, offset long")
    return blocks.join(F.broadcast(offsets), "shard").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def _decoded(row) -> Iterator[tuple]:
    start, counts = int(row.start), np.asarray(row.counts, np.int64)
    ids = simple8b.decode(np.frombuffer(row.words, "<u8"), int(counts.sum()))
    end = np.cumsum(counts)
    for doc_id, a, b in zip(row.doc_ids, end - counts, end, strict=True):
        yield None if doc_id is None or doc_id != doc_id else int(doc_id), start + int(a), ids[a:b]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: every document's ids, decoded from the files."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                got = list(_decoded(row))
                yield pd.DataFrame({"doc_id": pd.array([g[0] for g in got], "Int64"), "start": [g[1] for g in got],
                                    "ids": [g[2].astype(np.int64) for g in got]})
    return read_blocks(spark, path).mapInPandas(run, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                got = [(d, s, len(v), zlib.crc32(v.astype("<u4").tobytes())) for d, s, v in _decoded(row)]
                yield pd.DataFrame({"doc_id": pd.array([g[0] for g in got], "Int64"), "start": [g[1] for g in got],
                                    "n_tokens": [g[2] for g in got], "ids_crc32": [g[3] for g in got]})
    return read_blocks(spark, path).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
