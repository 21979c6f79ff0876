"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

A merge encoding is fixed by its prefixes: the encoding of a prefix ends in one token only, and the rest
is the encoding of the shorter prefix.  So a table of the last token of each prefix holds the whole
encoding.  An automaton over the vocabulary gives the tokens that end at a position; the one that is
compatible with the last token before it, meaning that merging the two tokens' text yields just these
two, enters the table.  Ids are then read backwards from the end.

Compatibility of two tokens needs no simulation: their last merges are undone one by one, latest first,
and the pair is compatible if no merge across the border would have come before.

No piece holds a blank sign after another character, and none holds a line feed, so texts are cut there
and the pieces of a cut are remembered in a table of bounded bytes.  A vocabulary for which this does not
hold is encoded without cuts.  Decoding gathers the bytes of all ids at once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import share, shared, with_columns

BLANK = "▁"
#: Bytes of each of the two generations of remembered chunks, and of remembered pairs, in one worker.
CHUNK_BYTES = 32 << 20
PAIR_BYTES = 24 << 20
#: What an entry takes besides its characters and ids: two objects and their place in the table.
ENTRY_BYTES = 150
PAIR_ENTRY_BYTES = 100
DECODE_IDS = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model; rank is the order in which merges come, -1 for characters."""

    pieces: dict[str, int]
    texts: list[str]
    rank: list[int]
    parts: list[tuple[int, int]]
    bytes_: list[bytes]
    byte_ids: list[int]
    n_ids: int
    bos: int
    eos: int


def merge_alone(text: str, pieces: dict[str, int], rank: dict[int, int]) -> list[tuple[str, tuple]]:
    """Merge the characters of ``text`` by rank, leftmost first: ``(piece, (left, right) or ())``."""
    parts: list[tuple[str, tuple]] = [(c, ()) for c in text]
    while len(parts) > 1:
        best = None
        for i in range(len(parts) - 1):
            found = pieces.get(parts[i][0] + parts[i + 1][0])
            if found is not None and (best is None or rank[found] < best[0]):
                best = (rank[found], i)
        if best is None:
            break
        i = best[1]
        pair = (parts[i][0], parts[i + 1][0])
        parts[i : i + 2] = [("".join(pair), pair)]
    return parts


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback and an identity normaliser."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces: dict[str, int] = {}
    bytes_ = [b""] * n
    byte_ids = [0] * 256
    for i in range(n):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            bytes_[i] = bytes([int(text[3:5], 16)])
        elif model.is_unknown(i):
            bytes_[i] = " ⁇ ".encode()
        elif not model.is_control(i):
            pieces[text] = i
            bytes_[i] = text.replace(BLANK, " ").encode()
    # A character inside a piece that is no piece itself gets an id of its own for merging.
    for c in sorted({c for text in pieces for c in text} - set(pieces)):
        pieces[c] = len(bytes_)
        bytes_.append(c.replace(BLANK, " ").encode())
    texts = [""] * len(bytes_)
    for text, i in pieces.items():
        texts[i] = text
    scores = {i: model.get_score(i) if i < n else 0.0 for i in pieces.values()}
    order = sorted({-s for s in scores.values()})
    place = {s: k for k, s in enumerate(order)}
    rank = {i: place[-s] for i, s in scores.items()}
    known, ranks, parts = {}, [-1] * len(bytes_), [(-1, -1)] * len(bytes_)
    for text, i in pieces.items():
        alone = merge_alone(text, pieces, rank)
        if len(alone) == 1:  # else no text ever merges into this piece
            known[text] = i
            if alone[0][1]:
                parts[i] = (pieces[alone[0][1][0]], pieces[alone[0][1][1]])
                ranks[i] = rank[i]
    return Vocabulary(
        known, texts, ranks, parts, bytes_, byte_ids, n, model.bos_id(), model.eos_id()
    )


class PrefixEncoder:
    """Encodes text with one vocabulary.

    ``chunk_bytes`` bounds each of the two generations of chunks whose ids are kept: when the younger is
    full it becomes the older, and what is used again moves back.
    """

    def __init__(self, vocabulary: Vocabulary, chunk_bytes: int = CHUNK_BYTES):
        self.v = vocabulary
        self.automaton = None
        self.characters = {t for t in vocabulary.pieces if len(t) == 1}
        inner = any(BLANK in t.lstrip(BLANK) or "\n" in t for t in vocabulary.pieces)
        # A space and the blank sign are the same to the model; plain text makes shorter keys.
        self.cuts = None if inner else re.compile(f"[ {BLANK}]+[^ {BLANK}\n]*|\n+|[^ {BLANK}\n]+")
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunk_bytes, self.held_bytes = chunk_bytes, 0
        single = np.zeros(len(vocabulary.bytes_), np.int64)
        single[:] = [len(b) for b in vocabulary.bytes_]
        self.lengths = single
        self.starts = np.concatenate([[0], np.cumsum(single)[:-1]])
        self.flat = np.frombuffer(b"".join(vocabulary.bytes_), np.uint8)

    def make_automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, i in self.v.pieces.items():
            automaton.add_word(text, (i, len(text)))
        automaton.make_automaton()
        return automaton

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of both tokens merges into just these two."""
        texts, rank, parts = self.v.texts, self.v.rank, self.v.parts
        # A merge across the border wins if its rank is below both: at equal rank the left one goes first.
        before_left = before_right = 1 << 60
        while True:
            crossing = self.v.pieces.get(texts[left] + texts[right])
            if crossing is not None:
                r = rank[crossing]
                if r < before_left and r <= before_right:
                    return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            # Undo the latest merge; at equal rank the right one came later.
            if rank[left] > rank[right]:
                before_left, left = rank[left], parts[left][1]
            else:
                before_right, right = rank[right], parts[right][0]

    def prefix_table(self, text: str) -> list[int]:
        """The last token of each prefix of ``text``, whose characters are all known."""
        last = [-1] * len(text)
        pairs = self.pairs
        if self.automaton is None:
            self.automaton = self.make_automaton()
        for end, (token, size) in self.automaton.iter(text):
            if last[end] >= 0:  # a prefix has one last token only
                continue
            before = end - size
            if before < 0:
                last[end] = token
                continue
            left = last[before]
            key = left << 24 | token
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) * PAIR_ENTRY_BYTES >= PAIR_BYTES:
                    pairs.clear()
                fits = pairs[key] = self.compatible(left, token)
            if fits:
                last[end] = token
        return last

    def encode_known(self, text: str) -> list[int]:
        last = self.prefix_table(text)
        ids, end = [], len(text) - 1
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= len(self.v.texts[token])
        ids.reverse()
        if max(ids) < self.v.n_ids:
            return ids
        return [x for i in ids for x in ([i] if i < self.v.n_ids else self.fallback(self.v.texts[i]))]

    def fallback(self, text: str) -> list[int]:
        return [self.v.byte_ids[b] for b in text.encode()]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text that no token spans, as little-endian unsigned 32-bit integers."""
        if self.characters.issuperset(chunk):
            return array("I", self.encode_known(chunk)).tobytes()
        ids: list[int] = []
        run: list[str] = []
        for c in chunk:
            if c in self.characters:
                run.append(c)
            else:  # no piece holds this character
                if run:
                    ids += self.encode_known("".join(run))
                    run = []
                ids += self.fallback(c)
        if run:
            ids += self.encode_known("".join(run))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids, with begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = np.array([[self.v.bos], [self.v.eos]], "<u4")
        if not text:
            return begin.tobytes() + end.tobytes()
        chunks = self.cuts.findall(" " + text) if self.cuts else [" " + text]
        known, out = self.chunks, [begin.tobytes()]
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = self.older.get(chunk)
                if ids is None:
                    ids = self.encode_chunk(chunk.replace(" ", BLANK))
                if len(chunk) < 100:
                    if self.held_bytes >= self.chunk_bytes:
                        self.older, self.held_bytes = known, 0
                        known = self.chunks = {}
                    known[chunk] = ids
                    self.held_bytes += ENTRY_BYTES + len(chunk) + len(ids)
            out.append(ids)
        out.append(end.tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of ``ids``; the blank put before a text goes, begin and end have no text."""
        tokens = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(tokens), DECODE_IDS):
            part = tokens[at : at + DECODE_IDS]
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            index = np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(
                ends[-1] if len(ends) else 0
            )
            out.append(self.flat[index].tobytes())
        text = b"".join(out)
        return text[1:] if text[:1] == b" " else text


TOKENS = T.StructType(
    [T.StructField("_ids", T.BinaryType()), T.StructField("_decoded", T.StringType())]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_decode(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """``docs`` with ``_ids`` (little-endian unsigned 32-bit) and ``_decoded`` text of every row.

    With ``digests`` the three columns ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` take their
    place.  A null text is encoded as an empty one: begin and end only.  Rows are independent, so ties
    and repeated rows need no rule, and an empty table gives an empty result.
    """
    box = share(docs.sparkSession, PrefixEncoder(read_vocabulary(model_path)))
    added = DIGESTS if digests else TOKENS

    def compute():
        encoder = shared(box)

        def batch(part: pa.RecordBatch) -> list[list]:
            rows = []
            for value in part.column("text"):
                ids = encoder.encode(value.as_py() or "")
                text = encoder.decode(ids)
                if digests:
                    rows.append(
                        (
                            len(ids) // 4,
                            hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(text).hexdigest(),
                        )
                    )
                else:
                    rows.append((ids, text.decode("utf-8", "replace")))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in added.fields]

        return batch

    return with_columns(docs, added, compute, tuple(added.names))


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    found = encode_decode(docs.select("doc_id", "text"), model_path, digests=True)
    return found.select("doc_id", *DIGESTS.names)
