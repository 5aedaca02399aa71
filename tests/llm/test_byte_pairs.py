"""Byte-pair encoding against the library, text by text and through the registered query."""

import hashlib
import random

import pytest

from nichefield.llm import byte_pairs

ODD = ["", " ", "  a  b ", "a\n\n b", "\t\t x \x0b", "日本 text", "x\0y", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "don't I'VE we'll 'tis", "\x1c\x1d \x85 \xa0²③",
       "İ É Ω ß", "w" * 3000, "ab" * 5000 + "1" * 700 + " " * 500, "🎉🎉 𝔘𝔫 𝟙", "é ​‍﻿", "١٢٣ ४५", "\U0010ffff", "Ġ Ċ <|endoftext", "'s's're"]


def library(many):
    tk = byte_pairs.library_at(byte_pairs.default_tokenizer())
    coded = [tk.encode(t, add_special_tokens=False).ids for t in many]
    return [(ids, tk.decode(ids, skip_special_tokens=False)) for ids in coded]


@pytest.mark.parametrize("remembered", [3, 100_000])
def test_equals_library(spark, monkeypatch, remembered):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", remembered)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\tabtheTH'sé1²日🎉.,!-\x1f ") for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(998, None, "x"), (None, "a b", "x"), (1, "again", "x")], "doc_id long, text string, tokens string")
    coded = byte_pairs.encode(docs)
    assert set(coded.columns) == set(docs.columns) and coded.count() == len(texts) + 3
    rows = {r["doc_id"]: r for r in byte_pairs.decode(coded, into="back").collect() if r["text"] != "again"}
    for i, (ids, back) in enumerate(library(texts)):
        assert rows[i]["tokens"] == ids and rows[i]["back"] == back == texts[i]
    assert rows[998]["tokens"] == [] and rows[998]["back"] == "" and rows[None]["back"] == "a b"
    assert byte_pairs.encode(docs.limit(0)).count() == 0 and byte_pairs.decode(coded.limit(0)).count() == 0


def test_any_ids_decode(spark):
    """Ids in an order that no text has decode as in the library, broken UTF-8 included."""
    rng = random.Random(5)
    tk = byte_pairs.library_at(byte_pairs.default_tokenizer())
    rows = [(i, [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(rng.randrange(12))]) for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in byte_pairs.decode(spark.createDataFrame([*rows, (-1, None)], "doc_id long, tokens array<int>")).collect()}
    assert got == {i: tk.decode(ids, skip_special_tokens=False) for i, ids in rows} | {-1: ""}


def test_merge_order():
    """The queue gives what repeated search for the least rank gives."""
    m = byte_pairs.model_at(byte_pairs.default_tokenizer(), byte_pairs.cutting_rule(byte_pairs.default_tokenizer()))
    rng = random.Random(7)
    for _ in range(300):
        word = bytes(rng.choice(b" aehinrst\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        ids = [m.first[b] for b in word]
        while pairs := [(m.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in m.merges]:
            i = min(pairs)[1]
            ids[i:i + 2] = [m.merges[ids[i], ids[i + 1]][1]]
        assert m.merged(word) == ids


def test_query(spark):
    got = {r["doc_id"]: tuple(r[1:]) for r in byte_pairs.op13_byte_pairs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(got)
    for (i, text), (ids, back) in zip(rows, library([t or "" for _, t in rows])):
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(back))
