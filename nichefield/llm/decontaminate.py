"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once and sent to the tasks after a check of its size; more items than the bound
are dealt into several automata and the documents stream past each. A document's words move through the automaton
with the length of the longest match that ends at each word. A match of at least a window marks its words as hit.

Words are runs of digits, letters and bytes outside ASCII, with A-Z lower-cased. A window is ``window`` consecutive
words of an item; an item with fewer words, but not none, is one window as a whole.

Defined cases: a null or empty text has no words and is never contaminated; an item without words matches nothing;
without items nothing is hit; repeated items all count; a repeated document identifier is judged row by row.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, pieces, table, texts, utf8

WINDOW = 13
#: Words of test items in one automaton (its states take some 150 MB in a worker at most).
AUTOMATON_WORDS = 200_000
#: Bytes that separate words become blanks, A-Z become a-z; all others stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        edges, self.shortest = set(), window
        #: State -> items: windows of full length by the state they reach, and items shorter than a window.
        self.full: dict[int, set[str]] = defaultdict(set)
        self.short: dict[int, set[str]] = defaultdict(set)
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for item, ws in items if ws]
        for _, ws in coded:
            self._add(ws)
            edges.update(zip(ws, ws[1:]))
            self.shortest = min(self.shortest, len(ws))
        self.has_short = [False] * len(self.link)
        for item, ws in coded:
            for _, state, matched in self.walk(ws):
                if matched >= window:
                    self.full[self._at(state, window)].add(item)
            if len(ws) < window:
                self.short[state].add(item)
        for state in np.argsort(self.length, kind="stable").tolist()[1:]:  # a link is shorter than its state
            self.has_short[state] = state in self.short or self.has_short[self.link[state]]
        v = max(1, len(self.ids))
        self.edges = np.array(sorted(a * v + b for a, b in edges), np.int64)

    def _add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            old = nxt[last].get(c)
            if old is not None and length[old] == length[last] + 1:
                last = old
                continue
            if old is None:
                cur = self._state({}, length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                link[cur] = 0 if p < 0 else self._reach(p, c)
                last = cur
            else:
                last = self._reach(last, c)

    def _reach(self, p: int, c: int) -> int:
        """The state for exactly the longest string of ``p`` followed by ``c``, split off if it must be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, nxt: dict[int, int], length: int) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _at(self, state: int, length: int) -> int:
        """The state that holds the suffix of ``length`` words of a longer match."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, coded):
        """(index, state, longest match that ends there) for each word; -1 matches nothing."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, c in enumerate(coded):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            state, matched = (0, 0) if to is None else (to, matched + 1)
            yield i, state, matched

    def runs(self, coded: np.ndarray):
        """Stretches in which each word and its successor are neighbours in some item, long enough for a window."""
        known = coded >= 0
        if len(coded) < self.shortest or not known.any():
            return
        joined = np.zeros(len(coded), bool)  # with the word before
        if len(self.edges):
            pair = coded[:-1].astype(np.int64) * max(1, len(self.ids)) + coded[1:]
            at = np.minimum(np.searchsorted(self.edges, pair), len(self.edges) - 1)
            joined[1:] = known[1:] & known[:-1] & (self.edges[at] == pair)
        starts = np.flatnonzero(~joined)
        sizes = np.diff(np.r_[starts, len(coded)])
        keep = known[starts] & (sizes >= self.shortest)
        yield from zip(starts[keep].tolist(), (starts[keep] + sizes[keep]).tolist())

    def judge(self, coded: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, stop) of a document, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        seen = set()
        for a, b in self.runs(coded):
            for i, state, matched in self.walk(coded[a:b].tolist()):
                size = 0
                if matched >= self.window:
                    size = self.window
                    at = self._at(state, size)
                    if at not in seen:
                        seen.add(at)
                        items |= self.full[at]
                if self.has_short[state]:
                    s = state
                    while s > 0:
                        # A state reached with a shorter match than its own length holds that match on its links.
                        if s in self.short and self.length[s] <= matched:
                            size = max(size, self.length[s])
                            items |= self.short[s]
                        s = self.link[s]
                if size:
                    start, stop = a + i + 1 - size, a + i + 1
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans[-1][0])
                        spans.pop()
                    spans.append((start, stop))
        return spans, items


def _judged(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    automaton = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(items, window))

    def stream(batches):
        a = automaton.value
        code = a.ids.get
        for piece in pieces(batches):
            out = {k: [] for k in ("n_words", "starts", "stops", "items")}
            for text in utf8(piece.column("text")):
                ws = words(text)
                spans, found = a.judge(np.fromiter((code(w, -1) for w in ws), np.int64, len(ws))) if ws else ([], ())
                out["n_words"].append(len(ws))
                out["starts"].append([s for s, _ in spans])
                out["stops"].append([e for _, e in spans])
                out["items"].append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text_hash"), pa.array(out["n_words"], pa.int64()), pa.array(out["starts"], pa.list_(pa.int64())),
                 pa.array(out["stops"], pa.list_(pa.int64())), pa.array(out["items"], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "starts", "stops", "items"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(stream, "doc_id bigint, text_hash bigint, n_words bigint, starts array<bigint>, stops array<bigint>, items array<string>")


def benchmark_parts(benchmark: DataFrame, automaton_words: int = AUTOMATON_WORDS):
    """The items in parts that one automaton can hold, read one part at a time: (item_id as text, its words).

    The number of parts comes from the size of the texts; an item is never cut.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // (2 * automaton_words)))  # a word and its separator take two bytes or more
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r["item_id"] or "", words(r["text"].encode())) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, starts, stops, items): spans of hit words, and the sorted items with occurring windows."""
    source = texts(docs)
    found = [_judged(source, items, window) for items in benchmark_parts(benchmark, automaton_words)]
    if len(found) == 1:
        return found[0].drop("text_hash")
    # Each part has judged each row: the rows of one text and identifier are as many as there are parts and copies.
    union = reduce(DataFrame.unionByName, found)
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))))
    merged = F.aggregate(spans, F.expr("cast(array() as array<struct<starts:bigint,stops:bigint>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stops"] >= s["starts"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["stops"], s["stops"]).alias("stops")))),
    ).otherwise(F.concat(acc, F.array(s))))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / len(found)).cast("int")))
    return (union.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.count(F.lit(1)).alias("n"),
                                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumn("copy", copies)
            .select("doc_id", "n_words", F.col("spans")["starts"].alias("starts"), F.col("spans")["stops"].alias("stops"), "items"))


def verdicts(found: DataFrame) -> DataFrame:
    """The digest columns: contaminated when a word is hit and hits are a twentieth of the words or more."""
    n_hit = F.aggregate(F.zip_with("stops", "starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_spans(text: bytes, starts, stops) -> bytes:
    """``text`` without its hit words; what stands between the words stays."""
    ends = np.flatnonzero(np.frombuffer(text.translate(FOLD) + b" ", np.uint8) == 32)
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    real = begins < ends
    begins, ends = begins[real], ends[real]
    out, at = [], 0
    for a, b in zip(starts, stops):
        out.append(text[at:begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows, whatever their identifiers."""
    return keep_rows(docs, lambda keyed: verdicts(contamination(keyed, benchmark, **options)).where("contaminated").select("doc_id"), False)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return verdicts(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op3_decontaminate": op3_decontaminate}
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
ORACLES = {"op3_decontaminate": f"""
    with d as materialized (select doc_id, {_WORDS} as w from documents),
         b as materialized (select item_id, {_WORDS} as w from benchmark),
         windows as materialized (
             select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as s
             from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
         sizes as (select distinct k from windows),
         places as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k),
         texts as materialized (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s from places),
         found as materialized (select t.doc_id, t.k, t.i, x.item_id from texts t join windows x on t.k = x.k and t.s = x.s),
         hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
         items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
                   from found group by doc_id)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
           sha256(coalesce(n.ids, '')) as items_sha256,
           coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
    from d left join hit h on h.doc_id = d.doc_id left join items n on n.doc_id = d.doc_id"""}
