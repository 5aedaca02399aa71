"""Byte-pair encoding and decoding with a priority queue of merges over a linked list of symbols.

A text is cut into pre-tokens, and no merge reaches across their borders, so each distinct pre-token of a batch is
encoded once and remembered in the worker. Its bytes become a doubly linked list of symbols. A queue holds the pairs
that can merge, least rank first and leftmost of equal ranks; a merge joins a symbol with the one after it and queues the
two pairs that this makes. An entry whose pair is no longer there is stale and skipped. A pre-token of n bytes takes
O(n log n) steps, so one without any blank does no harm. Decoding concatenates the vocabulary strings of the ids.

The cutting rule needs the classes of characters (letter, number, white space) as the library has them. They are asked
from the library once, on the driver, for all characters below U+10000; a text with others is cut by the library.

Defined cases: a null or empty text has no tokens; a special string inside a text becomes its special token and decodes
to itself; very long texts and pre-tokens are encoded whole; repeated rows, null and equal identifiers are encoded row
by row; an empty table gives an empty one; other columns stay as they are, and one named like the result is replaced.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import memory, only, pieces, sha256_of, table, texts

#: Pre-tokens whose ids a worker remembers from batch to batch.
REMEMBERED = 200_000
#: Bits of a queue entry that hold the place of the left symbol.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def library_at(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable bytes themselves, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _ranges(points: list[int]) -> str:
    """Code points in order, as the inside of a character class."""
    at = np.array(points)
    cut = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist()))


@lru_cache(maxsize=2)
def cutting_rule(path: str) -> str:
    """The library's pre-token pattern for characters below U+10000, with its own classes of characters spelled out."""
    cut = library_at(path).pre_tokenizer.pre_tokenize_str
    found: dict[str, list[int]] = {"letter": [], "number": [], "blank": []}
    for point in (*range(0xD800), *range(0xE000, 0x10000)):
        c = chr(point)
        if len(cut("a" + c)) == 1:
            found["letter"].append(point)
        elif len(cut("1" + c)) == 1:
            found["number"].append(point)
        elif len(cut("!" + c)) == 2:
            found["blank"].append(point)
    letter, number, blank = map(_ranges, found.values())
    short = "|".join("'" + x for x in ("s", "t", "re", "ve", "m", "ll", "d"))
    return f"{short}| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


class BytePairs:
    """Merge ranks and vocabulary strings of a byte-level tokenizer file."""

    def __init__(self, path: str, rule: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take their surroundings along are not supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        #: (left id, right id) -> (rank, id of both together)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.strings = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for s, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in added}
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split = re.compile("(" + ("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)") + ")")
        self.decimal = [str(i).encode() for i in range(len(self.strings))]
        self.cut, self.beyond = re.compile(rule).findall, re.compile("[\U00010000-\U0010ffff]").search
        self.library_cut = library_at(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids that merging by rank makes of a pre-token's bytes."""
        merges, first = self.merges, self.first
        ids = [first[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append(m[0] << PLACE_BITS | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue  # stale: the left symbol is gone, or nothing is left after it
            m = merges.get((ids[i], ids[j]))
            if m is None or m[0] != entry >> PLACE_BITS:
                continue  # stale: one of the two has grown since
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((ids[i], ids[k]))
                if m:
                    heappush(queue, m[0] << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], ids[i]))
                if m:
                    heappush(queue, m[0] << PLACE_BITS | h)
        return [x for x in ids if x >= 0]

    def units(self, text: str) -> list[str]:
        """The pre-tokens and special strings of a text, in order."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(part)
            elif self.beyond(part):
                out.extend(part[a:b] for _, (a, b) in self.library_cut(part))
            else:
                out.extend(self.cut(part))
        return out

    def encode(self, many: list[str]) -> list[bytes]:
        """Packed int32 ids of each text."""
        only("byte pairs")
        known, split = self.known, [self.units(t) for t in many]
        distinct = set().union(*split)
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            kept = {w: known[w] for w in distinct if w in known}
            known.clear()
            known.update(kept)
        for word in new:
            special = self.special.get(word)
            known[word] = np.array(self.merged(word.encode()) if special is None else [special], np.int32).tobytes()
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model_at(path: str, rule: str) -> BytePairs:
    return BytePairs(path, rule)


memory("byte pairs", model_at.cache_clear)


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with an array of token ids for each text; a column of that name is replaced. No shuffle."""
    path, df = tokenizer or default_tokenizer(), docs.drop(into)
    rule, names = cutting_rule(path), [*df.columns, into]
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def work(batches):
        m = model_at(path, rule)
        for piece in pieces(batches, text):
            packed = m.encode([t or "" for t in piece.column(text).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*piece.columns, ids], names=names)

    return df.mapInArrow(work, schema)


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "tokens", into: str = "text") -> DataFrame:
    """``encoded`` with the text that its ids stand for; null ids give an empty text."""
    path, df = tokenizer or default_tokenizer(), encoded.drop(into)
    rule, names = cutting_rule(path), [*df.columns, into]
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def work(batches):
        m = model_at(path, rule)
        for batch in batches:
            out = [m.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=names)

    return df.mapInArrow(work, schema)


def op13_byte_pairs(spark, sf_dir: str) -> DataFrame:
    """Per document the number of tokens, a digest of their ids and a digest of the text decoded from the ids."""
    path = default_tokenizer()
    rule = cutting_rule(path)

    def work(batches):
        m = model_at(path, rule)
        for piece in pieces(batches):
            n, coded, decoded = [], [], []
            for packed in m.encode(piece.column("text").to_pylist()):
                ids = np.frombuffer(packed, np.int32).tolist()
                n.append(len(ids))
                coded.append(sha256_of(map(m.decimal.__getitem__, ids)))
                decoded.append(sha256_of([m.decode(ids).encode()]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(table(spark, sf_dir, "documents")).mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op13_byte_pairs": op13_byte_pairs}
ORACLES: dict[str, str] = {}
