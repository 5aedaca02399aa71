"""Conversation repair against a plain version that lists all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from nichefield.llm import conversations

EXTRA = ", part string, seq string, digest string, key string, copies string"


def damaged(rows):
    """Rows after damage, by the rule of the query."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(n, 1)
    return out


def cheapest(rows):
    """(cost, edits, repaired lines) of (role, text, fault) rows: least cost, then least letters."""
    after = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 4:
            r = "a" if state == "u" else "u"
            c, e, t = best(i, r, inserts + 1)
            found.append((c + 5, "I" + e, ({"u": "user", "a": "assistant"}[r] + ":", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] and role[:1] in after[state]:
                    c, e, t = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + e, (f"{role}:{text}", *t)))
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        c, e, t = best(i + 1, new[0], 0)
                        found.append((c + extra + 1, "R" + e, (f"{new}:{text}", *t)))
        return min(found) if found else (10 ** 9, "", ())

    for i in range(len(rows), -1, -1):  # from the back, so that the recursion stays shallow
        for inserts in range(4, -1, -1):
            for state in after:
                best(i, state, inserts)
    return best(0, "", 0)


def expected(all_rows):
    """Per conversation what the query returns, from rows before damage."""
    rows, out = damaged(all_rows), {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    for conv in {r[0] for r in all_rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        seen, listed, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in mine:
            solid = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            listed.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(tuple(listed))
        out[conv] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q", "w") for r in rows], "conv_id long, turn long, role string, text string" + EXTRA)


def query(spark, df):
    got = conversations.digests(conversations.repair(conversations.damaged(df)), df).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[1:]) for r in got}


def talk(rng, conv, n, sloppy):
    rows = []
    for turn in range(n):
        role = ("user", "assistant")[turn % 2] if rng.random() > sloppy else rng.choice(["user", "assistant", "system", "tool", "", None])
        text = rng.choice(["Yes.", "No!", "a b?", "so it goes. ", "cut", "", " \n", None, "é.", "x. \x85"])
        rows.append((conv, rng.choice([turn] * 8 + [None, turn // 2]), role, rng.choice([text, f"{text or ''}{turn}."])))
    if rng.random() < 0.3:
        rows.insert(0, (conv, 0, "system", "Be kind."))
    return rows


@pytest.mark.parametrize("seed,sizes,sloppy", [(1, range(0, 9), 0.1), (2, range(0, 25), 0.4), (3, (150, 300, 3), 0.25), (4, (700,), 0.7)])
def test_query_equals_plain(spark, seed, sizes, sloppy):
    rng = random.Random(seed)
    rows = [r for conv in range(60 if max(sizes) < 100 else 3) for r in talk(rng, conv, rng.choice(list(sizes)), sloppy)]
    rows += [(None, 1, "user", "Who?"), (None, None, "assistant", None), (77, None, "user", "alone"), (78, 5, "user", "Hi."), (78, 5, "user", "Hi."), (78, 6, "assistant", "Ho.")]
    got, want = query(spark, frame(spark, rows).repartition(4)), expected(rows)
    assert got == want


def test_long_texts_and_many_repeats(spark):
    """One conversation holds most rows and very long texts; another repeats one row very often."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "word " * (40_000 if t % 50 == 0 else 3) + ".") for t in range(400)]
    rows += [(2, 0, "user", "Again.")] * 1000 + [(2, 1, "assistant", "Yes.")]
    assert query(spark, frame(spark, rows)) == expected(rows)


def test_all_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = frame(spark, [(gone, 0, "user", "Hi.")])
    assert query(spark, df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert query(spark, df.limit(0)) == {}


def test_edits_are_real(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi!"), (1, 2, "assistant", "So."), (1, 3, "user", " "), (1, 4, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repair(df).orderBy("part", "seq").collect()
    assert [(r["edit"], r["role"], r["text"], r["fault"]) for r in got] == [
        ("K", "system", "Be kind.", None), ("R", "user", "Hi!", None), ("K", "assistant", "So.", None), ("D", None, None, "blank"), ("D", None, None, "truncated")]
    assert sum(r["cost"] for r in got) == 5


def test_auction_prices():
    """Prices at the entries are the shortest distances, for any costs at the end."""
    rng = random.Random(9)
    for _ in range(400):
        rows = [rng.choice([("s", 0, False), ("u", 0, False), ("a", 0, False), ("u", 0, True), ("t", 0, False), ("a", 3, False)]) for _ in range(rng.randrange(0, 40))]
        exits = [rng.randrange(12) for _ in range(4)]
        far = [list(exits)]
        for row in reversed(rows):
            here = [conversations.CLOSED] * 4
            for _ in range(5):
                here = [min((here if not down else far[-1])[s] + c for _, c, down, s in conversations.arcs_of(*row, 3)[q]) for q in range(4)]
            far.append(here)
        assert conversations.Run(rows, exits).prices == far[-1]
        table = conversations.costs(rows)
        assert [min(table[q][e] + exits[e] for e in range(4)) for q in range(4)] == far[-1]
