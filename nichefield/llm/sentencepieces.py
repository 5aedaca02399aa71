"""SentencePiece encoding and decoding with a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which lays them out as a depth-first walk of their trie: a word keeps
the forward entries of the prefix that it shares with the word before, and only its new characters are worked on.

The public model at hand is a byte-pair model, whose pieces carry merge ranks rather than log-probabilities: the
segmentation with the greatest sum of scores is not the one the library gives. The forward entry of a prefix therefore
holds the piece that ends the merged form of that prefix. Exactly one piece fits: it must keep its own form when it
merges alone, and together with the piece that ends the shorter prefix. The results equal the library's.

Words are cut where no merge can reach across: before each run of marks, and around line feeds if no piece has one.

Defined cases: a null or empty text has no pieces; runs of blanks, literal marks and unknown characters (as byte
pieces) are encoded as the library does; a literal mark decodes to a blank, so only such a text is changed by a round trip.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import memory, only, pieces, sha256_of, table, texts

MARK = "▁"
#: Words whose pieces a worker remembers: as many that were met of late, and as many before those.
REMEMBERED = 120_000
#: Pairs of pieces and parts of words that a worker remembers what it has found out about.
PAIRS, NODES = 250_000, 60_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces and ranks of a SentencePiece byte-pair model, and the forward pass over sorted words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.rank = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.breaks = not any("\n" in p for p in self.ids)
        #: What pieces hold: the longest of these that ends a prefix decides which pieces can end it.
        self.parts = {p[i:k] for p in self.ids for k in range(len(p) + 1) for i in range(k)}
        self.nodes: dict[str, tuple] = {}
        self.start = self._node("")
        self.raw = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, tuple[bool, float, str, str]] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _built(self, piece: str) -> tuple[bool, float, str, str]:
        """Whether a piece merges alone to itself, when its last merge comes, and the two parts it joins; by best rank, leftmost of equals."""
        known = self.alone.get(piece)
        if known is not None:
            return known
        parts, rank, last, when = list(piece), self.rank, (piece, piece), -1.0
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            last, when = (parts[at], parts[at + 1]), -best
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        known = self.alone[piece] = len(parts) == 1, when, *last
        return known

    def _node(self, part: str) -> tuple:
        """(part, next nodes by character, the pieces that end it and merge alone to themselves, longest first)."""
        node = self.nodes.get(part)
        if node is None:
            fits = (part[k:] for k in range(len(part)) if part[k:] in self.ids)
            node = self.nodes[part] = part, {}, tuple(p for p in fits if self._built(p)[0])
        return node

    def _advance(self, node: tuple, c: str) -> tuple:
        part = node[0] + c
        while part not in self.parts and part:
            part = part[1:]
        after = node[1][c] = self._node(part)
        return after

    def _pair(self, left: str, right: str) -> bool:
        """Whether both pieces stay apart: at no time before one of them was whole could what then met at the seam merge.

        The later of the two last merges is undone again and again, which shows what met at the seam before it.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        rank, a, b, limit, ok = self.rank, left, right, float("inf"), False
        _, when_a, _, tail = self._built(a)
        _, when_b, head, _ = self._built(b)
        while True:
            r = rank.get(a + b)
            if r is not None and -r < limit:
                break
            if when_a > when_b:
                a, limit = tail, when_a
                _, when_a, _, tail = self._built(a)
            elif when_b >= 0:
                b, limit = head, when_b + 0.5  # of merges of equal rank the left one, at the seam, comes first
                _, when_b, head, _ = self._built(b)
            else:
                ok = True
                break
        self.pairs[left, right] = ok
        return ok

    def forward(self, words: list[str]):
        """Packed piece ids of each of the sorted, distinct words."""
        ids, pairs = self.ids, self.pairs
        if len(self.nodes) > NODES:
            self.nodes.clear()
            self.start = self._node("")
        last: list[str | None] = [None]  # by prefix length: the piece that ends it, None for an unknown character
        path = [self.start]  # by prefix length: the node of the longest part that ends it
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], path[shared + 1:]
            node = path[-1]
            for i in range(shared, len(word)):
                c = word[i]
                node = node[1].get(c) or self._advance(node, c)
                found = None
                for piece in node[2]:
                    left = last[i + 1 - len(piece)]
                    if left is not None:
                        ok = pairs.get((left, piece))
                        if not (self._pair(left, piece) if ok is None else ok):
                            continue
                    found = piece
                    break
                last.append(found)
                path.append(node)
            out, i = [], len(word)
            while i:
                piece = last[i]
                if piece is None:
                    out.extend(self.byte[b] for b in reversed(word[i - 1].encode()))
                    i -= 1
                else:
                    out.append(ids[piece])
                    i -= len(piece)
            yield word, array("i", out[::-1]).tobytes()
            before = word

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or "  " in text or MARK in text or "\0" in text or not self.breaks:
            stops = f"{MARK}\n" if self.breaks else MARK
            return re.findall(f"{MARK}+[^{stops}]*|[^{stops}]+|\n", MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).split("\0")

    def encode(self, many: list[str]) -> list[bytes]:
        """Packed int32 piece ids of each text."""
        only("pieces")
        split = [self.units(t) for t in many]
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:  # words not met since the last change are given up
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for word in distinct.difference(known):
            ids = older.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        new.sort()
        known.update(self.forward(new))
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.raw.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


memory("pieces", model_at.cache_clear)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with an array of piece ids for each text; a column of that name is replaced. No shuffle."""
    path, df = model or default_model(), docs.drop(into)
    names = [*df.columns, into]
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def work(batches):
        m = model_at(path)
        for piece in pieces(batches, text):
            packed = m.encode([t or "" for t in piece.column(text).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*piece.columns, ids], names=names)

    return df.mapInArrow(work, schema)


def decode(encoded: DataFrame, model: str | None = None, ids: str = "pieces", into: str = "text") -> DataFrame:
    """``encoded`` with the text that its piece ids stand for; null ids give an empty text."""
    path, df = model or default_model(), encoded.drop(into)
    names = [*df.columns, into]
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def work(batches):
        m = model_at(path)
        for batch in batches:
            out = [m.decode(x or ()).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=names)

    return df.mapInArrow(work, schema)


def op5_sentencepieces(spark, sf_dir: str) -> DataFrame:
    """Per document the number of pieces, a digest of their ids, and whether decoding gives the text back."""
    path = default_model()

    def work(batches):
        m = model_at(path)
        for piece in pieces(batches):
            many = piece.column("text").to_pylist()
            packed = [np.frombuffer(p, np.int32) for p in m.encode(many)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(p) for p in packed], pa.int64()),
                 pa.array([sha256_of([p.astype("<i4").tobytes()]) for p in packed]),
                 pa.array([m.decode(p.tolist()) == t.encode() for p, t in zip(packed, many)], pa.bool_())],
                names=["doc_id", "n_pieces", "pieces_sha256", "round_trip"])

    return texts(table(spark, sf_dir, "documents")).mapInArrow(work, "doc_id bigint, n_pieces bigint, pieces_sha256 string, round_trip boolean")


QUERIES = {"op5_sentencepieces": op5_sentencepieces}
ORACLES: dict[str, str] = {}
