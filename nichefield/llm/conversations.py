"""Conversation structure repair: cheapest edits by an auction for shortest paths.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its rows span a lattice: a node is a
number of rows passed and one of four states (nothing yet, after system, after user, after assistant); arcs are the
edits D (delete, 2), I (insert, 5), K (keep, 0) and R (rerole, 1), with 5 more for a truncated row that is not deleted.
``auction`` finds the cheapest path: every node has a price, none above the cost of an arc plus the price at its end. The path
from the origin grows along the arc that attains the price of its last node, and where none does that price is raised and
the path withdraws by one node. When the path arrives, every arc of any cheapest path is tight (price = cost + price at
its end), so the edits with the least letters are traced along tight arcs from which the end is reached by tight arcs.

Rows are range-partitioned by conversation and turn, so that a conversation of any length is spread over tasks, and
checkpointed. Each task works on runs of one conversation, in blocks of ``BLOCK`` rows from the back. A run that borders
another partition may go on there: for those (two per partition at most) a table of 4 x 4 costs is combined first to
give the prices at its end, then the states in which the runs before leave, to give the state in which it is entered.

Defined cases: rows come by turn (nulls first), equal turns by role and a digest of the text; a null role or text is one
space; a null identifier is a conversation of its own; a role with another initial, or none, cannot be kept; equal rows
are repeats; a conversation of any length and texts of any length are worked on whole; an empty table gives an empty one;
only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepare, shuffle_width, table, with_keys

#: The costs of the edits, and the state after the next legal role (user, or assistant after user).
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: What a conversation still costs at its end, by state, and the edits that it then needs.
AT_END, END_EDITS = (0, 10, 5, 0), ((), (2, 3), (3,), ())
BLANK_BYTES = " \t\n\x0b\f\r"
CLOSED = 1 << 60
#: Rows of a lattice that one auction works on, and bytes of repaired text in one piece.
BLOCK, PIECE = 16, 1 << 20


@lru_cache(maxsize=4096)
def arcs_of(initial: str, times: int, truncated: bool, top: int):
    """By state the arcs (edit, cost, rows passed, next state) of a row, edits in order; ``times`` > 0: so many rows that must go."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE * max(times, 1), 1, q)]
        if NEXT[q] <= top:
            arcs.append(("I", INSERT, 0, NEXT[q]))
        if not times:
            kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(initial)
            extra = TRUNCATED * truncated
            if kept is not None and kept <= top:
                arcs.append(("K", extra, 1, kept))
            if NEXT[q] <= top:
                arcs.append(("R", REROLE + extra, 1, NEXT[q]))
        out.append(tuple(arcs))
    return tuple(out)


def auction(rows, exits, entries, top: int = 3):
    """Prices of the nodes of a block, exact on the cheapest paths from ``entries`` to the states that cost ``exits`` from there on.

    Prices start at what must be deleted anyway, which no arc contradicts. States above ``top`` are left out.
    """
    n, floor = len(rows), min(exits)
    price = [[floor] * 4]
    for _, times, _ in reversed(rows):
        floor += DELETE * times
        price.append([floor] * 4)
    price.reverse()
    net = [arcs_of(*row, top) for row in rows]
    for origin in entries:
        path = [(0, origin)]
        while True:
            i, q = path[-1]
            best, to = CLOSED, None
            if i == n:
                best = exits[q]
            else:
                for _, cost, down, state in net[i][q]:
                    c = cost + price[i + down][state]
                    if c < best:
                        best, to = c, (i + down, state)
            if price[i][q] < best:
                price[i][q] = best
                if len(path) > 1:
                    path.pop()
            elif to is None:  # arrived, or no way out of the origin
                break
            else:
                path.append(to)
    return price, net


def reaching(price, net, exits):
    """Whether each node has a way of tight arcs to the end of its block."""
    good = [[p == e < CLOSED for p, e in zip(price[-1], exits)]]
    for i in range(len(net) - 1, -1, -1):
        here, below = [False] * 4, good[-1]
        for _ in range(4):  # insertions stay in the layer
            here = [any(price[i][q] == cost + price[i + down][s] and (below if down else here)[s] for _, cost, down, s in net[i][q]) for q in range(4)]
        good.append(here)
    return good[::-1]


class Run:
    """The lattice of a run of rows, solved block by block from the back."""

    def __init__(self, rows, exits=AT_END, entries=range(4), top: int = 3):
        self.blocks = []
        starts = list(range(0, len(rows), BLOCK))
        for start in reversed(starts):
            asked = range(top + 1) if start else entries
            price, net = auction(rows[start:start + BLOCK], exits, asked, top)
            self.blocks.append((price, net, exits))
            exits = [*price[0][:top + 1], *[CLOSED] * (3 - top)]
        self.blocks.reverse()
        self.prices = exits

    def trace(self, state: int):
        """The edits (edit, cost, rows passed, next state) from a state of entry, least letters first among the cheapest."""
        for price, net, exits in self.blocks:
            good, i = reaching(price, net, exits), 0
            while i < len(net):
                arc = next((label, cost, down, s) for label, cost, down, s in net[i][state] if price[i][state] == cost + price[i + down][s] and good[i + down][s])
                yield arc
                i, state = i + arc[2], arc[3]


def costs(rows) -> list[list[int]]:
    """Cost of a run from each state of entry (rows) to each state at its end (columns)."""
    columns = []
    for e in range(4):
        top = 3 if e > 1 else 1
        columns.append(Run(rows, [0 if q == e else CLOSED for q in range(4)], range(top + 1), top).prices)
    return [[columns[e][q] for e in range(4)] for q in range(4)]


# Rows in tasks


def runs(batches, names):
    """(identifier, rows as tuples of ``names``) for each stretch of one conversation in a partition."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", *names))))
    for ident, group in groupby(rows, key=lambda r: r[0]):
        yield ident, [r[1:] for r in group]


LOOK = ("turn", "role", "digest", "blank", "truncated", "seen", "copies")


def faults(rows):
    """(row number, lattice row, fault) of rows that begin with the columns ``LOOK``: a row and then its repeats."""
    before = None
    for k, (turn, role, digest, blank, truncated, seen, copies, *_) in enumerate(rows):
        repeat = seen or before == (turn, role, digest)
        before = turn, role, digest
        if blank or repeat:
            yield k, (role[:1], copies, False), "blank" if blank else "duplicate"
            continue
        yield k, (role[:1], 0, truncated), "truncated" if truncated else None
        if copies > 1:
            yield k, (role[:1], copies - 1, False), "duplicate"


def edge_costs(batches):
    """The table of costs of the first and the last run of a partition, which may go on in others."""
    def row(ident, run):
        flat = [c for line in costs([r for _, r, _ in faults(run)]) for c in line]
        return pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([run[0][-1]], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])

    first, last = True, None
    for ident, run in runs(batches, (*LOOK, "part")):
        if first:
            yield row(ident, run)
            first = False
        else:
            last = ident, run
    if last:
        yield row(*last)


PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("prices", pa.list_(pa.int64())), ("last", pa.bool_())])


def prices_behind(runs_of_one: pa.Table) -> pa.Table:
    """For each part of a conversation that has several, what is still to pay behind it, by state."""
    exits, out = list(AT_END), []
    if runs_of_one.num_rows > 1:
        for r in sorted(runs_of_one.to_pylist(), key=lambda r: -r["part"]):
            out.append({"conv_id": r["conv_id"], "part": r["part"], "prices": exits, "last": not out})
            exits = [min(min(r["costs"][4 * q + e] + exits[e], CLOSED) for e in range(4)) for q in range(4)]
    return pa.Table.from_pylist(out, PARTS)


def leaving(batches):
    """The state in which each part is left, by the state in which it is entered."""
    for ident, run in runs(batches, (*LOOK, "part", "prices")):
        solved = Run([r for _, r, _ in faults(run)], run[0][-1])
        states = []
        for q in range(4):
            state = q
            if solved.prices[q] < CLOSED:
                for *_, state in solved.trace(q):
                    pass
            states.append(state)
        yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([run[0][-2]], pa.int32()), pa.array([states], pa.list_(pa.int32()))], names=["conv_id", "part", "leaves"])


def entered(parts_of_one: pa.Table) -> pa.Table:
    """The state in which each part of a conversation is entered."""
    state, out = 0, []
    for r in sorted(parts_of_one.to_pylist(), key=lambda r: r["part"]):
        out.append({k: r[k] for k in PARTS.names} | {"entry": state})
        state = r["leaves"][state]
    return pa.Table.from_pylist(out, PARTS.append(pa.field("entry", pa.int32())))


EDITS = "conv_id bigint, part int, seq bigint, edit string, times bigint, cost bigint, turn bigint, role_before string, fault string, role string, text string"


def edits_of(batches):
    """The edits of each run: a row of the conversation with what becomes of it, or an inserted row."""
    names = [f.split()[0] for f in EDITS.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in EDITS.split(", ")]
    out, size = [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for ident, run in runs(batches, (*LOOK, "text", "part", "prices", "last", "entry")):
        part, exits, last, entry = run[0][-4:]
        listed = list(faults(run))
        entry = entry or 0
        solved = Run([r for _, r, _ in listed], AT_END if exits is None else exits, (entry,))
        at, state, seq = 0, entry, 0
        for label, cost, down, state in solved.trace(entry):
            if not down:
                row = (None, None, None, ROLES[state], "")
            else:
                k, (_, times, _), fault = listed[at]
                turn, role, text = run[k][0], run[k][1], run[k][len(LOOK)]
                row = (turn, role, fault, {"K": role, "R": ROLES.get(state)}.get(label), None if label == "D" else text)
                at += 1
            out.append((ident, part, seq, label, max(times, 1) if down else 1, cost, *row))
            size, seq = size + 64 + len(row[-1] or ""), seq + 1
        if exits is None or last:
            for s in END_EDITS[state]:
                out.append((ident, part, seq, "I", 1, INSERT, None, None, None, ROLES[s], ""))
                seq += 1
        if size > PIECE:
            yield packed()
            out, size = [], 0
    if out:
        yield packed()


# The operator


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a checksum of their number, for tests of a repair."""
    ident, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    number = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        ident.alias("conv_id"), turn.alias("turn"), F.when(number == 4, "user").otherwise(role).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(number == 0, 0).when(number == 3, 2).otherwise(1).cast("bigint").alias("copies")).where("copies > 0")


def _counted(batches):
    """Equal rows of a batch as one with the sum of their copies."""
    for batch in batches:
        if batch.num_rows:
            keys = [c for c in batch.schema.names if c != "copies"]
            sums = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("copies", "sum")])
            yield from pa.table([sums.column(c if c in keys else "copies_sum") for c in batch.schema.names], batch.schema.names).to_batches()


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order, spread by ranges of conversation and turn, with what is wrong with each; checkpointed.

    Rows repeated very often are summed up in each task before they travel. Whether role and text were seen in an earlier
    turn comes from an aggregation over digests, of which only those met twice are joined back.
    """
    spark, trimmed = rows.sparkSession, F.rtrim("text", F.lit(BLANK_BYTES))
    known = rows.select("conv_id", "turn", "role", "text", "copies").withColumns({
        "digest": F.unhex(F.sha2("text", 256)), "key": F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text"), 256)),
        "blank": trimmed == "", "truncated": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    seen = checkpointed(known.where("not blank").groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("key", "first"))
    marked = with_keys(known, seen, "key", "left").withColumn("seen", F.coalesce(order > F.col("first"), F.lit(False)))
    marked = marked.select("conv_id", "turn", "role", "text", "digest", "blank", "truncated", "seen", "copies")
    return checkpointed(marked.mapInArrow(_counted, marked.schema).repartitionByRange(shuffle_width(spark), "conv_id", "turn", "role", "digest")
                        .sortWithinPartitions("conv_id", "turn", "role", "digest").withColumn("part", F.spark_partition_id()))


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that make each conversation of (conv_id, turn, role, text[, copies]) well formed, in order of (part, seq).

    One row per edit: ``edit`` D, I, K or R, done ``times`` times, at a ``cost``; ``turn``, ``role_before`` and ``fault`` of the
    row (null for insertions); ``role`` and ``text`` of what stands there afterwards (null if deleted).
    """
    prepare(rows.sparkSession)
    full = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))} | ({} if "copies" in rows.columns else {"copies": F.lit(1).cast("bigint")}))
    at = placed(full)
    looks = at.select("conv_id", *LOOK, "part")
    edges = checkpointed(looks.mapInArrow(edge_costs, "conv_id bigint, part int, costs array<bigint>"))
    several = checkpointed(edges.groupBy("conv_id").applyInArrow(prices_behind, "conv_id bigint, part int, prices array<bigint>, last boolean"))

    def with_parts(df: DataFrame, parts: DataFrame, how: str) -> DataFrame:
        # Two rows per partition at most, by construction.
        other = F.broadcast(parts.withColumnsRenamed({"conv_id": "_conv", "part": "_part"}))
        return df.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), how).drop("_conv", "_part")

    left = with_parts(looks, several, "inner").select("conv_id", *LOOK, "part", "prices").mapInArrow(leaving, "conv_id bigint, part int, leaves array<int>")
    known = with_parts(left, several, "inner").groupBy("conv_id").applyInArrow(entered, "conv_id bigint, part int, prices array<bigint>, last boolean, entry int")
    return with_parts(at, checkpointed(known), "left").select("conv_id", *LOOK, "text", "part", "prices", "last", "entry").mapInArrow(edits_of, EDITS)


# Digests of the edits

LEGAL = {"su", "ua", "au"}
DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PIECES = "conv_id bigint, part int, seq bigint, counts array<bigint>, first_turn bigint, last_turn bigint, first_initial string, last_initial string, audit string, body binary, sha256 string"


class Piece:
    """Sums over consecutive edits of a conversation; ``counts`` are turns, blank, duplicate, truncated, illegal, cost."""

    def __init__(self):
        self.counts, self.turns, self.initials, self.audit, self.lines, self.size = [0] * 6, [None, None], [None, None], [], [], 0

    def border(self, turns, initials):
        """Count what two neighbours share: a turn that began before, and roles that cannot follow each other."""
        if turns[0] is not None:
            self.counts[0] -= turns[0] == self.turns[1]
            self.turns = [turns[0] if self.turns[0] is None else self.turns[0], turns[1]]
        if initials[0] is not None:
            self.counts[4] += self.initials[1] is not None and self.initials[1] + initials[0] not in LEGAL
            self.initials = [initials[0] if self.initials[0] is None else self.initials[0], initials[1]]

    def add(self, part, seq, edit, times, cost, turn, before, fault, role, text):
        if before is not None:
            self.counts[0] += turn is not None
            self.border([turn, turn], [before[:1], before[:1]])
            self.counts[4] += times - 1
            if fault:
                self.counts[("blank", "duplicate", "truncated").index(fault) + 1] += times
        self.counts[5] += cost
        self.audit.append(edit * times)
        if role is not None:
            self.lines.append(f"{role}:{text}".encode())
            self.size += len(self.lines[-1])

    def row(self, ident, part, seq, whole):
        body = b"\n".join(self.lines)
        return (ident, part, seq, self.counts, *self.turns, *self.initials, "".join(self.audit), None if whole or not self.lines else body, hashlib.sha256(body).hexdigest() if whole else None)


def pieces_of(batches):
    """Sums of each run of edits; a run inside a partition is a whole conversation and needs no text any more."""
    names = [f.split()[0] for f in EDITS.split(", ")][1:]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in PIECES.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", *names))))
    out, held, first = [], None, True
    for ident, group in groupby(rows, key=lambda r: r[0]):
        piece, parted = Piece(), False
        if held:
            out.append(held[0].row(*held[1:4], not (first or held[4])))
            first = False
        for _, *edit in group:
            part, seq = edit[:2]
            piece.add(*edit)
            if piece.size > PIECE:
                yield packed([*out, piece.row(ident, part, seq, False)])
                out, piece, parted = [], Piece(), True
        held = piece, ident, part, seq, parted
        if len(out) >= 1000:
            yield packed(out)
            out = []
    if held:
        out.append(held[0].row(*held[1:4], False))
    if out:
        yield packed(out)


def summed(batches):
    """The sums of each conversation, whose pieces come in order; texts only pass through the digest."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kept = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    out = []
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names)))
    for ident, group in groupby(rows, key=lambda r: r[0]):
        total, sha, begun, digest = Piece(), hashlib.sha256(), False, None
        for _, part, _, counts, first_turn, last_turn, first_initial, last_initial, audit, body, whole in group:
            if part is None:
                continue  # names the conversation, which may have no rows left
            total.counts = [a + b for a, b in zip(total.counts, counts)]
            total.border([first_turn, last_turn], [first_initial, last_initial])
            total.audit.append(audit)
            digest = whole
            if body is not None:
                sha.update(b"\n" * begun + body)
                begun = True
        turns, *faulty = total.counts
        low, high = total.turns
        out.append((ident, 0 if low is None else high - low + 1 - turns, *faulty, "".join(total.audit), digest or sha.hexdigest()))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kept)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kept)


def digests(edits: DataFrame, idents: DataFrame) -> DataFrame:
    """Per conversation of ``idents`` the counts of its faults, its cost, its edits and a digest of the repaired rows.

    Sums and texts of a conversation that lies in several partitions meet in one task, text after text: a digest over a
    whole conversation has to be taken in order.
    """
    fields = [f.split(" ") for f in PIECES.split(", ")]
    names = idents.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in fields[1:]])
    ordered = edits.mapInArrow(pieces_of, PIECES).union(names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(summed, DIGEST)


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digests(repair(damaged(conversations)), conversations)


QUERIES = {"op12_conversations": op12_conversations}
ORACLES: dict[str, str] = {}
