"""Operators against plain versions, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from nichefield.llm import (decontaminate, exact_dedup, lm_scoring, ngram_join, quality, sentencepieces, token_counts, url_lists, warc)

#: Extra columns named like those the operators use inside.
EXTRA = "key string, n string, row string, fp string, block string, u string, v string, pieces string, score string, refers_to string"


def frame(spark, rows, extra=True):
    tail = EXTRA if extra else ""
    width = len(EXTRA.split(",")) if extra else 0
    return spark.createDataFrame([(i, t, *["x"] * width) for i, t in rows], "doc_id long, text string" + (", " + tail if tail else ""))


def near_copies(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    base = [[word() for _ in range(rng.randrange(3, 60))] for _ in range(5)]
    rows = []
    for _ in range(n):
        ws = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(20)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            ws[rng.randrange(len(ws))] = word()
        rows.append((rng.choice(" \t\n") or " ").join(ws).upper() if rng.random() < 0.2 else " ".join(ws))
    rows += ["", " \n ", None, "one", "ONE", "one two", "One  two\t", rows[0], rows[0]]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_shingles": 60, "buckets": 3}), (3, {"block_shingles": 150, "broadcast_keys": 0, "hot_shingles": 0})])
def test_ngram_join(spark, seed, options):
    rows = near_copies(seed, 70)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame(spark, rows).repartition(3), **options).collect()}
    want = brute.groups(rows)
    assert got == {i: (len(brute.shingles(t)), want[i]) for i, t in rows}


def test_ngram_join_hot_family(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        ws = list(base)
        ws[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, " ".join(base[:30] + [f"y{i}_{k}" for k in range(60)])) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(frame(spark, rows), block_shingles=700).collect()}
    assert got == brute.groups(rows)


def test_ngram_join_odd_rows(spark):
    """Rows with null or repeated identifiers are judged one by one; components take the smallest identifier in them."""
    rows = [(7, "a b c d e f"), (7, "p q r s t u"), (3, "A B C D E F"), (9, "p q r s t u"), (None, "a b c d e f"), (None, "one of its kind here"), (5, "x y"), (5, "x y")]
    got = sorted((tuple(r) for r in ngram_join.similar_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 2, 3), (7, 2, 3), (None, 2, 3), (7, 2, 7), (9, 2, 7), (None, 1, None), (5, 1, 5), (5, 1, 5)], key=str)
    assert ngram_join.similar_groups(frame(spark, rows).limit(0)).count() == 0
    docs = frame(spark, [(1, "a b c"), (2, "a b c"), (3, None), (4, "")])
    kept = ngram_join.drop_similar(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and set(kept.columns) == set(docs.columns)


def kept_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_removal_goes_by_row(spark):
    """No unique text goes with a copy of its identifier, and no copy stays because it has none."""
    rows = [(7, "A"), (7, "B"), (9, "A"), (None, "C"), (1, "C"), (2, "C"), (8, "D"), (8, "D"), (None, None), (None, "")]
    got = kept_rows(exact_dedup.drop_copies(frame(spark, rows)))
    assert len(got) == 5 and got[:4] == [(2, "C"), (7, "B"), (8, "D"), (9, "A")] and got[4][0] is None and not got[4][1]
    words = "w1 w2 w3 w4 w5 w6 w7 w8"
    rows = [(4, "only this one is here"), (4, words), (1, words), (6, "twice the same row is here"), (6, "twice the same row is here"), (None, words), (None, "no name no copy"), (2, None)]
    assert kept_rows(ngram_join.drop_similar(frame(spark, rows))) == sorted(
        [(4, "only this one is here"), (1, words), (6, "twice the same row is here"), (None, "no name no copy"), (2, None)], key=str)
    dirty = "q1 q2 q3 q4 q5 q6 q7 q8 q9 qa qb qc qd qe"
    bench = spark.createDataFrame([(1, dirty)], "item_id long, text string")
    rows = [(5, dirty), (5, "clean text here"), (None, dirty), (None, "clean too"), (6, "clean"), (6, "clean"), (3, None)]
    assert kept_rows(decontaminate.drop_contaminated(frame(spark, rows), bench)) == sorted(
        [(5, "clean text here"), (None, "clean too"), (6, "clean"), (6, "clean"), (3, None)], key=str)


def test_first_parts_never_part_linked_sets():
    """Linked sets have as many elements in common in their first parts as the join asks for."""
    rng = random.Random(11)
    for _ in range(3000):
        a = rng.sample(range(400), rng.randrange(1, 80))
        b = [x for x in a if rng.random() < 0.93] + rng.sample(range(400, 500), rng.randrange(0, 9))
        a, b = sorted(set(a)), sorted(set(b))
        if b and 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)):
            parts = [set(x[:ngram_join.first_part(len(x))]) for x in (a, b)]
            assert len(parts[0] & parts[1]) >= ngram_join.common_asked(len(a), len(b), 75) >= 1


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_exact_dedup(spark, broadcast_keys):
    texts = ["a", "A", "a", None, "", "b" * 5000, "b" * 5000, "b" * 4999, "a", "é"]
    docs = frame(spark, list(enumerate(texts))).repartition(4)
    got = {r["doc_id"]: tuple(r[1:]) for r in exact_dedup.exact_groups(docs, bits=2, broadcast_keys=broadcast_keys).collect()}
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in same.items() for i in g}
    assert got == want
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == sorted(max(g) for g in same.values())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_needs_bytes(spark, monkeypatch):
    """Texts of one fingerprint are told apart by their bytes."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda c: F.lit(5).cast("bigint"))
    got = exact_dedup.exact_groups(frame(spark, [(1, "a"), (2, "b"), (3, "a"), (None, "c"), (None, "c")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"]) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, 2, True)] * 2


def test_counting_filters():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 3000)]
    for bits in (0, 3):
        packed = [list(exact_dedup.pack(p, np.ones(len(p), np.int64), bits)) for p in np.array_split(prints, 4)]
        found = {}
        for q in {q for rows in packed for q, _, _ in rows}:
            low, n = exact_dedup.merge([(r, c) for rows in packed for k, r, c in rows if k == q])
            found |= dict(zip((low + exact_dedup.whole(q, bits)).tolist(), n.tolist()))
        assert found == Counter(prints.tolist())


@pytest.mark.parametrize("automaton_words", [3, 200_000])
def test_decontaminate(spark, automaton_words):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randrange(0, 9))) for i in range(12)] + [(20, None), (21, "A-b.C"), (21, "d d d d d d"), (None, "c c a")]
    rows = [(i, text(rng.randrange(0, 40)).replace(" ", rng.choice([" ", "--", "\n"]))) for i in range(60)] + [(99, None), (98, ""), (98, "a b c"), (97, "É a b c é")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contamination(frame(spark, rows), bench, window=4, automaton_words=automaton_words)
    got = sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["stops"])), r["items"]) for r in found.collect())
    named = [("" if i is None else i, t) for i, t in items]
    assert got == sorted((i, *brute.contamination(t, named, 4)) for i, t in rows)
    verdict = {(r["doc_id"], r["n_words"]): r["contaminated"] for r in decontaminate.verdicts(found).collect()}
    assert all(verdict[i, n] == (h > 0 and 20 * h >= n) for i, n, h, _ in got)
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.remove_spans(b"One, two. three-four!", [1, 3], [2, 4]) == b"One, . three-!"


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stones", "and", "meadows"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!", "CLICK!!", "***", "%%%"]) for _ in range(60))
    kinds = [i % 3 != 0 for i in range(400)]
    docs = frame(spark, [(i, good() if k else bad()) for i, k in enumerate(kinds)] + [(900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(i, int(k), "t") for i, k in enumerate(kinds)] + [(900, None, "t"), (0, 1, "t"), (901, 7, "t")], "doc_id long, quality int, text string")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert all(got[i]["predicted"] == int(k) for i, k in enumerate(kinds) if got[i]["held_out"])
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 403
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} >= {i for i, k in enumerate(kinds) if k}
    one = quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert [r[0] for r in one] == [1.0]
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


ODD = ["", " ", "  a  b ", "a\n\nb", "▁x", "日本 text", "x\0y", "<s> <|endoftext|> don't", "'''s \x1c\x85²", "İ É Ω", "w" * 3000, "🎉"]


def test_sentencepieces(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \nabthe▁éö日'!1s") for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = frame(spark, [*enumerate(texts), (998, None), (None, "a b"), (1, "again")])
    coded = sentencepieces.encode(docs)
    assert set(coded.columns) == set(docs.columns) and coded.count() == len(texts) + 3
    rows = {r["doc_id"]: r for r in sentencepieces.decode(coded, into="back").collect() if r["text"] != "again"}
    assert all(rows[i]["pieces"] == sp.encode(t) for i, t in enumerate(texts))
    assert all(rows[i]["back"] == t for i, t in enumerate(texts) if "▁" not in t) and rows[998]["pieces"] == []
    assert sentencepieces.encode(docs.limit(0)).count() == 0


def test_token_counts(spark):
    path = token_counts.default_tokenizer()
    docs = frame(spark, [*enumerate(ODD * 2), (998, None)])
    got = {r["doc_id"]: tuple(r[1:]) for r in token_counts.token_counts(docs, limit=5).collect()}
    sizes = token_counts.sizes(token_counts.tokenizer_at(path), ODD * 2)
    assert got == {i: (len(t.encode()), n, n > 5) for (i, t), n in zip(enumerate(ODD * 2), sizes)} | {998: (0, 0, False)}
    assert len(token_counts.whole_tokens(path)) > 10_000 and token_counts.token_counts(docs.limit(0)).count() == 0
    whole = sorted(token_counts.whole_tokens(path))[::500]
    assert token_counts.sizes(token_counts.tokenizer_at(path), whole) == [1] * len(whole)


@pytest.mark.parametrize("frequent", [5, 1000])
def test_lm_scores(spark, frequent):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "Cat", "dog", "runs", f"r{rng.randrange(90)}"]) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, ""]
    rows = [*enumerate(texts), (3, "the repeated row")]
    got = sorted(tuple(r) for r in lm_scoring.scores(frame(spark, rows), frequent=frequent).collect())
    split = [(i, brute.lower(t).split() + ["end"]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in split if not held(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = sorted((i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)) for i, ws in split)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want))
    assert all(g[6] < 0 for g in got)
    assert lm_scoring.scores(frame(spark, rows).limit(0)).count() == 0


def test_lm_is_a_distribution():
    """Shares of all words and of unknown ones add to one for any history."""
    hashes = np.sort(np.random.default_rng(1).integers(1, 1 << 62, 50, dtype=np.uint64))
    m = lm_scoring.LanguageModel(hashes, np.arange(1, 51), 1500, 60)  # 1275 known tokens, 10 rare words with 225
    m.set_classes(np.arange(50) % (lm_scoring.CLASSES - 1))
    m.weights = np.random.default_rng(2).normal(size=m.weights.shape).astype(np.float32)
    rows = m.features([np.array([4, 51]), np.array([9, 51]), np.array([7, 51])])
    p = m.spread(m.weights, rows)
    words = 10 ** m.word[:-1]
    rare = (225 + 10 + 1) * 10 ** -m.rare_share
    assert np.allclose([(q[m.classes[:-1]] * words).sum() + q[m.rare] * rare for q in p], 1, atol=1e-5)


def test_lm_step_in_one_pass(monkeypatch):
    """A step has the gradients' sums by feature, whatever the runs, and needs no sum run by run."""
    rng = np.random.default_rng(4)
    m = lm_scoring.LanguageModel(np.sort(rng.integers(0, 1 << 62, 50, dtype=np.uint64)), np.arange(1, 51), 1500, 60)
    rows, wanted = (rng.zipf(1.3, (3000, 4)) % 400).astype(np.uint16), rng.integers(0, 16, 3000)
    weights = rng.normal(size=m.weights.shape).astype(np.float32)
    expected, energy = weights.astype(float), np.zeros(len(weights))
    g = np.exp(sum(expected[rows[:, k]] for k in range(4)) + expected[-1])
    g /= g.sum(1, keepdims=True)
    g[np.arange(3000), wanted] -= 1
    for k in range(5):
        at = rows[:, k].astype(int) if k < 4 else np.full(3000, lm_scoring.FEATURES)
        n = np.bincount(at, minlength=len(weights))
        step = np.zeros(weights.shape)
        np.add.at(step, at, g)
        step[n > 0] /= np.sqrt(n[n > 0])[:, None]
        energy += (step ** 2).mean(1)
        expected[n > 0] -= (lm_scoring.RATE * step / np.sqrt(energy + 1)[:, None])[n > 0]

    class Add:
        reduceat = None

    monkeypatch.setattr(lm_scoring, "np", type("numpy", (), {**vars(np), "add": Add}))
    m.learn(weights, np.zeros(len(weights), np.float32), rows, wanted)
    assert np.allclose(weights, expected, atol=1e-4)


def test_lm_tail_words_are_history(spark):
    """Words outside the frequent table tell as history what comes next."""
    rows = [(i, f"z{i % 40} {'ab'[i % 2]}") for i in range(4000)]
    asked = [(10_000 + 2 * i + k, f"z{i} {'ab'[k]}") for i in range(40) for k in (0, 1)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scores(frame(spark, rows + asked), frequent=3, is_held_out=lambda i: i >= 10_000).collect()}
    gain = [got[10_000 + 2 * i + i % 2] - got[10_000 + 2 * i + 1 - i % 2] for i in range(40)]
    assert min(gain) > 0.1


def test_lm_tail_classes():
    """Words outside are dealt to classes that grow with their number, and all shares still add to one."""
    assert lm_scoring.tail_classes(10) == 1 and lm_scoring.tail_classes(4_000_000) == 16
    hashes = np.sort(np.random.default_rng(1).integers(1, 1 << 62, 50, dtype=np.uint64))
    m = lm_scoring.LanguageModel(hashes, np.arange(1, 51), 1500, 60, [100, 75, 60])  # 225 rare tokens, 10 rare words
    m.set_classes(np.arange(50) % (lm_scoring.CLASSES - 1))
    m.weights = np.random.default_rng(2).normal(size=m.weights.shape).astype(np.float32)
    outside = np.random.default_rng(3).integers(1, 1 << 62, 1000, dtype=np.uint64) | np.uint64(lm_scoring.OUTSIDE)
    assert set(m.class_of(outside)) == {m.rare, m.rare + 1, m.rare + 2}
    p = m.spread(m.weights, m.features([outside, outside[::-1], outside]))
    shares = np.array([101, 76, 61]) * 10 ** -m.rare_share
    assert np.allclose(p[:, m.classes[:-1]] @ 10 ** m.word[:-1] + p[:, m.rare:] @ shares, 1, atol=1e-5)


def test_url_lists(spark):
    entries = spark.createDataFrame([
        ("block", "domain", "bad.org", 10, "add"), ("block", "domain", "bad.org", 20, "remove"), ("block", "domain", "bad.org", 20, "add"),
        ("allow", "host", "ok.bad.org", 5, "add"), ("block", "prefix", "x.com/a/b", 0, "add"), ("allow", "prefix", "x.com/a/b", 0, "add"),
        (None, "host", "y.com", 0, "add"), ("block", "host", None, 0, "add"), ("block", "host", "y.com", None, "add")], "list string, kind string, pattern string, at int, action string")
    captures = spark.createDataFrame([(1, "http://www.Bad.org/q", 15), (2, "http://bad.org", 20), (3, "http://bad.org", 9), (4, "https://ok.bad.org/z", 12), (5, "http://x.com/a/b/c?d", 3),
                                      (6, None, 3), (7, "nonsense", 3), (8, "http://y.com/", 3), (9, "http://www.bad.org", None), (1, "http://www.Bad.org/q", 15)], "page_id long, url string, fetched int")
    for limit in (0, 1000):
        got = sorted((r["page_id"], r["n_active"], r["verdict"]) for r in url_lists.judge(captures.withColumn("list", captures.url), entries, broadcast_intervals=limit).collect())
        assert got == [(1, 1, "block"), (1, 1, "block"), (2, 0, "none"), (3, 0, "none"), (4, 2, "allow"), (5, 2, "block"), (6, 0, "none"), (7, 0, "none"), (8, 0, "none"), (9, 0, "none")]
    odd = ["http://user:pw@www.bad.org/x", "http://a@b@Bad.org:8080", "http://bad.org./x", " \thttp://bad.org\n", "//bad.org/x", "http://good.org/@bad.org", "http://good.org?u=//bad.org",
           "http://[::1]:80/x", "mailto:a@bad.org", "http://", "http://x.com/a/b/" + "c/" * 20_000, "http://bad.org@good.org/"]
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_lists.judge(spark.createDataFrame([(i, u, 12) for i, u in enumerate(odd)], "page_id long, url string, fetched int"), entries).collect()}
    assert [got[i] for i in range(len(odd))] == [("www.bad.org", "block"), *[("bad.org", "block")] * 4, *[("good.org", "none")] * 2, ("[::1]", "none"), ("", "none"), ("", "none"),
                                                 ("x.com", "block"), ("good.org", "none")]
    assert url_lists.judge(captures, entries.limit(0)).where("verdict <> 'none'").count() == 0
    assert url_lists.judge(captures.limit(0), entries).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(32, 0x2500)) for _ in range(40_000))
    pages = [(1, "http://a/é?x", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", noise), (6, "http://e", "WARC/1.1\r\n\r\n\x1f"), (None, "http://f", "z")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, first string").repartition(2)
    archives = warc.write_archives(warc.with_revisits(df), f"file://{tmp_path}/w")
    for split in (64, 5000, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(spark, archives, split).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5, 6]
        assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
        for i, _, html in pages[:-1]:
            payload = (html or "").encode()
            assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == warc.digest(payload)
            assert got[i]["payload"] == (None if got[i]["record_type"] == "revisit" else payload)
    assert {r["record_type"] for r in warc.read_archives(spark, warc.write_archives(warc.with_revisits(df, 5), f"{tmp_path}/v"), 999).where("page_id < 3").collect()} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(warc.with_revisits(df.limit(0)), f"{tmp_path}/u")).count() == 0


def test_warc_pages_without_identifier(spark, tmp_path):
    """op9 returns a row for every page, also those whose page_id is null."""
    pages = [(1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (None, "w", "alone"), (None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(repr, (tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).collect())))
    row = lambda page, html, refers: (page, len(html), warc.digest(html.encode()), "response" if refers is None else "revisit", refers)
    assert got == sorted(map(repr, [row(1, "same", 2), row(2, "same", None), row(None, "same", 2), row(None, "alone", None), row(None, "alone", None), row(None, "", None)]))


def test_warc_false_magic(tmp_path):
    """Bytes that look like a member, before, between and inside records, are passed over."""
    import gzip
    stored = gzip.compress(b"not a record", 0)
    parts = [b"\x1f\x8b\x08junk", warc.member(1, "u", b"one", None), stored, warc.member(2, "u", warc.MAGIC * 50, None), b"\x1f", warc.member(3, "u", b"three", 1)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    size = path.stat().st_size
    for step in (1, 7, 50, size):
        got = [r["warc-identified-page"] for s in range(0, size, step) for r in warc.records(str(path), s, s + step, read_bytes=16)]
        assert got == ["1", "2", "3"]


def test_sentencepieces_query(spark):
    """The registered query gives the library's ids for whole documents."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r[1:]) for r in sentencepieces.op5_sentencepieces(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = sp.encode(r["text"] or "")
        assert got[r["doc_id"]][:2] == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())


@pytest.mark.parametrize("remembered", [2, 100_000])
def test_sentencepieces_memory(monkeypatch, remembered):
    """Words given up and met again, and cleared pairs and nodes, change nothing."""
    import sentencepiece
    monkeypatch.setattr(sentencepieces, "REMEMBERED", remembered)
    monkeypatch.setattr(sentencepieces, "PAIRS", remembered * 10)
    monkeypatch.setattr(sentencepieces, "NODES", remembered * 10)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    m, rng = sentencepieces.PieceModel(sentencepieces.default_model()), random.Random(12)
    for _ in range(30):
        many = [" ".join("".join(rng.choice("aeinrstlouéß▁日1.") for _ in range(rng.randrange(1, 14))) for _ in range(12)) for _ in range(8)]
        assert [np.frombuffer(p, np.int32).tolist() for p in m.encode(many)] == [sp.encode(t) for t in many]


def test_url_query_equals_twin_on_odd_urls(spark, tmp_path):
    import duckdb
    urls = ["http://user:pw@www.bad.org/x/y", "http://a@b@Bad.org:8080", "http://bad.org./x", " \thttp://bad.org\n", "//bad.org/x", None, "", "nonsense", "http://good.org/@bad.org",
            "http://[::1]:80/x", "mailto:a@bad.org", "http://", "HTTP://É.example/ä?q#f", "http://bad.org@good.org/", "http://x.y.z.../p"]
    rows = [(i, urls[i % len(urls)], None) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in url_lists.op7_url_lists(spark, str(tmp_path)).select("page_id", "host", "fetched", "n_active", "verdict", "decided_by").collect())
    assert got == sorted(con.sql(url_lists.ORACLES["op7_url_lists"]).fetchall()) and {r[4] for r in got} == {"none", "block", "allow"}
