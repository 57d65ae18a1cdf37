"""SentencePiece encoding and decoding with shared prefixes.

A text is cut into marked words (a run of marks "\\u2581" that stands for spaces, then characters without one);
no piece reaches over such a cut. Per batch the distinct words are sorted, which lays them out as a trie in depth-first
order; the forward state of every prefix is computed once and reused by all words below it. The forward step is
Viterbi over the pieces that end at a position:

* unigram models: the best sum of piece scores;
* BPE models: a path is allowed only where each pair of neighbouring pieces is itself a BPE result (a
  transition scores 0 or is forbidden). Exactly one path is, and it is what merging by rank gives, so the ids are the library's.

An automaton over all pieces (Aho-Corasick) gives those that end at a position, the longest first. Whether two pieces are
neighbours is told by undoing their merges, the latest first, as long as no merge over the border would have come before.

Characters outside the vocabulary become byte pieces where the model has them, else the unknown id.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; a mark
character in a text is a space, as in the library; very long words are handled at their whole length; an empty table
gives an empty result; repeated rows are coded each; other columns are kept. A model file of another kind than BPE or unigram is an error.

Bounds: a worker codes ``BATCH_CHARS`` of text at once (or one longer text) and returns them before the next; the words and pairs that it
remembers are bounded by ``CACHE_BYTES`` and ``CACHE_PAIRS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

MARK = "\u2581"
BATCH_CHARS = 1 << 20
CACHE_BYTES = 8 << 20  # of each of the two generations of words that a worker remembers, with their ids
CACHE_PAIRS = 200_000  # pairs of pieces of which a worker remembers whether they are neighbours
WORD_BYTES = 230  # what a remembered word takes besides its letters and ids

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# fixed values: model types of the file format
_KINDS = {1: "unigram", 2: "bpe"}
_TOP = 0x110000


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, blob[at:at + size]
        at += size


def model_kind(blob: bytes) -> str:
    """"bpe" or "unigram" of a serialised model: field 3 of its field 2, the trainer's settings; unigram where it is not said."""
    trainer = b"".join(v for k, v in _fields(blob) if k == 2)
    kind = dict(_fields(trainer)).get(3, 1)
    if kind not in _KINDS:
        raise ValueError(f"models of type {kind} are not handled")
    return _KINDS[kind]


class Pieces:
    """A vocabulary: pieces with scores, and byte pieces. ``kind`` is "bpe" or "unigram"."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str = "bpe", bytes_at: dict[int, int] | None = None,
                 unknown: int = 0, plain: list[int] | None = None):
        self.pieces, self.scores, self.kind, self.bytes_at, self.unknown = pieces, scores, kind, bytes_at or {}, unknown
        plain = list(range(len(pieces)) if plain is None else plain)
        self.id_of = {pieces[i]: i for i in plain}
        self.worst = min((scores[i] for i in self.id_of.values()), default=0.0) - 10.0
        self.ids_of = [np.int32(i).tobytes() for i in range(len(pieces))]
        byte_of = {i: b for b, i in self.bytes_at.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)]
        self._automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_size = 0

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """From a model file, read by the sentencepiece library."""
        from sentencepiece import SentencePieceProcessor
        m = SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        at = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], model_kind(m.serialized_model_proto()), at,
                   m.unk_id(), plain)

    def _automaton(self) -> None:
        """step[node][char] leads on, back[node] to the longest suffix that is a node; ends[node]: (size, id) of the pieces that end there."""
        self.step: list[dict[str, int]] = [{}]
        own = [0]
        for p, k in self.id_of.items():
            node = 0
            for c in p:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    own.append(-1)
                node = self.step[node][c]
            own[node] = k
        self.back = [0] * len(self.step)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        level = [(0, 0, "")]
        while level:
            deeper = []
            for node, above, c in level:
                if above or node:
                    back = self.back[above]
                    while above and back and c not in self.step[back]:
                        back = self.back[back]
                    self.back[node] = self.step[back].get(c, 0) if above else 0
                    longer = ((len(self.pieces[own[node]]), own[node]),) if own[node] >= 0 else ()
                    self.ends[node] = longer + self.ends[self.back[node]]
                deeper += [(to, node, char) for char, to in self.step[node].items()]
            level = deeper

    def merged(self, text: str) -> list[str]:
        """The BPE result by its definition: merge the best-scored pair, the leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _half(self, k: int) -> tuple[int, int] | None:
        """The two pieces that the last merge of a piece joins; none for a character."""
        if k not in self._halves:
            parts = list(self.pieces[k])
            while len(parts) > 2:
                pairs = [(self.scores[m], -i) for i in range(len(parts) - 1) if (m := self.id_of.get(parts[i] + parts[i + 1])) is not None]
                if not pairs:
                    break
                at = -max(pairs)[1]
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._halves[k] = (self.id_of.get(parts[0], -1), self.id_of.get(parts[1], -1)) if len(parts) == 2 else None
        return self._halves[k]

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether BPE leaves the pieces a and b as they are, side by side."""
        got = self._fits.get(a * _TOP + b)
        if got is None:
            if len(self._fits) > CACHE_PAIRS:
                self._fits.clear()
            got = self._fits[a * _TOP + b] = self._undone(a, b)
        return got

    def _undone(self, a: int, b: int) -> bool:
        pieces, scores, best = self.pieces, self.scores, float("-inf")
        strictly = False
        while True:
            over = self.id_of.get(pieces[a] + pieces[b])
            # a merge over the border came before the one undone last; of equal ones the left comes first
            if over is not None and (scores[over] > best or scores[over] == best and not strictly):
                return False
            x, y = self._half(a), self._half(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and scores[a] < scores[b]:
                best, strictly, a = scores[a], True, x[1]
            else:
                best, strictly, b = scores[b], False, y[0]

    def segment_all(self, words: list[str]) -> dict[str, bytes]:
        """The ids (as bytes) of distinct words; states along common prefixes are computed once."""
        out: dict[str, bytes] = {}
        # per end position of the current word: automaton node, last piece, score and ids of the best path
        node_at, last, score, path, before = [0], [-1], [0.0], [b""], ""
        step, back, ends, unigram, fits = self.step, self.back, self.ends, self.kind == "unigram", self._neighbours
        ids_of, scores, n = self.ids_of, self.scores, len(self.pieces)
        for word in sorted(words):
            shared, top = 0, min(len(word), len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del node_at[shared + 1:], last[shared + 1:], score[shared + 1:], path[shared + 1:]
            node = node_at[shared]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                while node and c not in step[node]:
                    node = back[node]
                node = step[node].get(c, 0)
                piece, start, best = -1, end - 1, None
                if unigram:
                    single = False
                    for size, k in ends[node]:
                        single |= size == 1
                        s = score[end - size] + scores[k]
                        if best is None or s > best:
                            piece, start, best = k, end - size, s
                    s = score[end - 1] + self.worst
                    if not single and (best is None or s > best):
                        piece, start, best = -1, end - 1, s
                else:
                    for size, k in ends[node]:
                        # an unknown character (an id from n on) joins with nothing
                        if size == end or last[end - size] >= n or fits(last[end - size], k):
                            piece, start = k, end - size
                            break
                node_at.append(node)
                score.append(best or 0.0)
                if piece >= 0:
                    last.append(piece)
                    path.append(path[start] + ids_of[piece])
                else:
                    last.append(n)
                    path.append(path[start] + self._outside(c, path[start]))
            out[word] = path[len(word)]
            before = word
        return out

    def _outside(self, char: str, before: bytes) -> bytes:
        """The ids of a character outside the vocabulary; unknown ones in a row are one."""
        if self.bytes_at:
            return b"".join(self.ids_of[self.bytes_at[b]] for b in char.encode("utf-8", "surrogatepass"))
        return b"" if before.endswith(self.ids_of[self.unknown]) else self.ids_of[self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids (int32)."""
        words = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.known_size > CACHE_BYTES:  # what is not asked for again while the next generation fills is forgotten
            self.older, self.known, self.known_size = self.known, {}, 0
        new = set().union(*words) - self.known.keys()
        found = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in found)
        self.known.update(self.segment_all(list(new - found)))
        self.known_size += sum(WORD_BYTES + len(w) + len(self.known[w]) for w in new)
        known, unknown = self.known.__getitem__, self.ids_of[self.unknown]
        if self.bytes_at:
            return [np.frombuffer(b"".join(map(known, ws)), np.int32) for ws in words]
        out = []
        for ws in words:  # unknown ids in a row are one, over words too
            ids = b""
            for part in map(known, ws):
                ids += part[4:] if ids.endswith(unknown) and part.startswith(unknown) else part
            out.append(np.frombuffer(ids, np.int32))
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces become characters (invalid ones the replacement character), the first mark goes."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[str, Pieces] = {}


def _pieces(model_file: str) -> Pieces:
    """One vocabulary, with its memory of words, for all tasks that a Python worker runs."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces.load(model_file)
    return _loaded[model_file]


def _slices(sizes: np.ndarray, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in size, a larger row alone."""
    a, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > a and total + size > limit:
            yield a, i
            a, total = i, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def _coded(rows: DataFrame, source: Column, schema: T.StructType, model_file: str,
           code: Callable[[Pieces, pa.Array], dict[str, pa.Array]]) -> DataFrame:
    """Rows with new columns by ``code`` from the column ``source``; a slice goes back before the next is coded."""
    name = free_name(rows, "_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_file)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pa.compute.list_value_length(column) if pa.types.is_list(column.type) else pa.compute.binary_length(column)
            for a, b in _slices(sizes.fill_null(0).to_numpy(zero_copy_only=False)):
                new = code(pieces, column.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)) for f in schema.fields],
                    names=[f.name for f in schema.fields])
    return rows.select("*", source.alias(name)).mapInArrow(run, schema)


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    """A list column; None is null."""
    ends = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in ids]))).astype(np.int32)
    values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=pa.array([x is None for x in ids], pa.bool_()))


def _encoded(pieces: Pieces, column: pa.Array) -> tuple[list[str | None], list[np.ndarray | None]]:
    texts = column.to_pylist()
    ids = pieces.encode([t or "" for t in texts])
    return texts, [None if t is None else x for t, x in zip(texts, ids, strict=True)]


def _decoded(pieces: Pieces, column: pa.Array) -> list[str | None]:
    return [None if x is None else pieces.decode(x) for x in column.to_pylist()]


def _with(rows: DataFrame, name: str, kind: str) -> T.StructType:
    return rows.withColumn(name, F.lit(None).cast(kind)).schema


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", ids_name: str = "ids") -> DataFrame:
    """The rows with their ids (array<int>) in place of any column of that name."""
    schema = _with(docs, ids_name, "array<int>")
    name = next(f.name for f in schema.fields if f.name.lower() == ids_name.lower())
    return _coded(docs, F.col(text_col).cast("string"), schema, model_file, lambda p, c: {name: _lists(_encoded(p, c)[1])})


def decoded(rows: DataFrame, model_file: str, ids_col: str = "ids", text_name: str = "text") -> DataFrame:
    """The rows with the text that their ids stand for."""
    schema = _with(rows, text_name, "string")
    name = next(f.name for f in schema.fields if f.name.lower() == text_name.lower())
    return _coded(rows, F.col(ids_col).cast("array<int>"), schema, model_file, lambda p, c: {name: pa.array(_decoded(p, c), pa.string())})


def coded(docs: DataFrame, model_file: str, text_col: str = "text", ids_name: str = "ids") -> DataFrame:
    """``encoded`` and ``decoded`` in one pass: the ids, and the text as decoded from them."""
    schema = _with(docs, ids_name, "array<int>")
    ids, text = (next(f.name for f in schema.fields if f.name.lower() == x.lower()) for x in (ids_name, text_col))

    def both(pieces: Pieces, column: pa.Array) -> dict[str, pa.Array]:
        own = _encoded(pieces, column)[1]
        return {ids: _lists(own), text: pa.array([None if x is None else pieces.decode(x) for x in own], pa.string())}
    return _coded(docs, F.col(text_col).cast("string"), schema, model_file, both)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 (of the text decoded from the ids, in UTF-8), lossless (whether it is the text)."""
    def both(pieces: Pieces, column: pa.Array) -> dict[str, pa.Array]:
        texts, ids = _encoded(pieces, column)
        back = [None if x is None else pieces.decode(x) for x in ids]
        return {"n_pieces": pa.array([0 if x is None else len(x) for x in ids], pa.int64()), "ids": _lists(ids),
                "decoded_sha256": pa.array([None if x is None else sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
                "lossless": pa.array([None if x is None else x == t for t, x in zip(texts, back, strict=True)], pa.bool_())}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_pieces", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()),
                           T.StructField("lossless", T.BooleanType())])
    return _coded(rows.select("doc_id", "text"), F.col("text"), schema, model_file, both)
