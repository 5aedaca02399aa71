"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by encoding each of them with the library; the
proved set (bounded by the vocabulary) travels to the tasks. A text is cut into pre-tokens, those in the set count one
each, and only the other distinct pre-tokens are merged by the library, in batches, and remembered.

The cutting rule is proved equal to the library's for characters below U+0250; a text with other characters, or with a
special string of the tokenizer inside, is encoded by the library as a whole.

Defined cases: a null or empty text has no tokens; repeated rows are counted row by row.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import memory, only, pieces, table, texts

MAX_TOKENS = 2048
#: Pre-tokens whose counts a worker remembers from batch to batch.
REMEMBERED = 250_000
#: Fixed value: the pre-token pattern in the tokenizer's file for which the shortcut is stated.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same, with white space spelled out: engines differ on control characters.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")
FOREIGN = re.compile("[^\x00-ɏ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer_at(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def sizes(tokenizer, many: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(many, add_special_tokens=False)]


def whole_tokens(path: str) -> set[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if PATTERN not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
        return set()
    end = spec["model"].get("end_of_word_suffix") or ""
    strings = [v.removesuffix(end) for v in spec["model"]["vocab"] if v.endswith(end) and v != end]
    strings = [s for s in strings if CUT.fullmatch(s) and not FOREIGN.search(s) and s == s.lower()]
    return {s for s, n in zip(strings, sizes(tokenizer_at(path), strings)) if n == 1}


_counted: dict[str, dict[str, int]] = {}
memory("token counts", _counted.clear)


def counter(path: str, proved: set[str]):
    """A function from texts to their token counts."""
    tokenizer = tokenizer_at(path)
    special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
    known = _counted.setdefault(path, dict.fromkeys(proved, 1))

    def counts(many: list[str]) -> list[int]:
        only("token counts")
        out, cut = [0] * len(many), []
        whole = [i for i, t in enumerate(many) if FOREIGN.search(t) or special.search(t)] if proved else range(len(many))
        for i, n in zip(whole, sizes(tokenizer, [many[i] for i in whole])):
            out[i] = n
        skip = set(whole)
        cut = [(i, CUT.findall(t.lower())) for i, t in enumerate(many) if i not in skip]
        rest = set().union(*(tokens for _, tokens in cut))
        rest.difference_update(known)
        if len(known) + len(rest) > REMEMBERED:
            used = set().union(*(tokens for _, tokens in cut))
            kept = {t: known[t] for t in used if t in known} | dict.fromkeys(proved, 1)
            known.clear()
            known.update(kept)
        rest = list(rest)
        known.update(zip(rest, sizes(tokenizer, rest)))
        get = known.__getitem__
        for i, tokens in cut:
            out[i] = sum(map(get, tokens))
        return out

    return counts


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text."""
    path = tokenizer or default_tokenizer()
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def work(batches):
        counts = counter(path, proved.value)
        for piece in pieces(batches):
            many = piece.column("text").to_pylist()
            n = counts(many)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(t.encode()) for t in many], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
