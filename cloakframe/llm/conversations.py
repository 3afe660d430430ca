"""Repair of conversation structure by cheapest edits, solved once per shared suffix.

A conversation becomes a string of signatures, one letter per row: what its
role can be to the grammar, and its fault.  Read from the end, equal suffixes
of all conversations are one node of an acyclic automaton.  The node holds,
for every grammar state, the cost to go and the best audit suffix; of that
only the relative costs, and the order of the four suffixes, bear on the
nodes before it, so nodes that agree in these are one class and a step from
class to class is solved once.  Signatures are range-sorted by their reverse:
those with a common suffix are neighbours, and what they share is not visited
again.

No conversation has to fit a task.  Rows are range-sorted by conversation and
turn; a run of rows gives a piece of the signature, and a piece that does not
hold a whole conversation also tells, for every class behind it, the class in
front of it and where the grammar leaves it.  Pieces of one conversation are
chained by that.  Texts stay out of all this; they are read in order once, at
the end, as a stream.

Grammar of the role initials: nothing, or an optional s and then ua repeated.
Edits: K keep (0), R rerole to user or assistant (3), D delete (4, a must for
blank and duplicate rows), I insert an empty row of user or assistant (3);
an undeleted truncated row costs 3 more.  Of cheapest edits the audit that is
least by code point counts.

Defined cases: a null role or text is one space, and so is a null conv_id or
turn where damage is drawn.  Rows without turn come first, rows of one turn
are ordered by role and the digest of the text, so repeated rows are
neighbours; a null conv_id is a conversation of its own.  A conversation
without rows has zeros, an empty audit and the digest of nothing.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.common import stored

PIECE = 4096
SALTS = 32
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a kept row, by its role initial; where a row of user or assistant leads.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: x is a row that must go; small letters are sound rows, large ones truncated rows.
SYMBOLS = "xsuaoSUAO"
SOUND = r"[^\x20\x09-\x0D]"


class Node:
    """A class of suffixes: relative cost to go and order of the best audits, by grammar state."""

    __slots__ = ("costs", "ranks")

    def __init__(self, costs: tuple[int, ...], ranks: tuple[int, ...]):
        self.costs, self.ranks = costs, ranks


def _ranks(keys: list) -> tuple[int, ...]:
    order = sorted(set(keys))
    return tuple(order.index(k) for k in keys)


END = Node((0, 6, 3, 0), _ranks(["", "II", "I", ""]))


def _before(node: Node, symbol: str) -> tuple[Node, int, list[tuple[str, int]]]:
    """The class in front of one row: (class, cost taken off it, per state the letter and the state it leads to)."""
    late = 3 if symbol in "SUAO" else 0
    best = []
    for g in range(4):
        choices = [(4 + node.costs[g], "D", node.ranks[g], g)]
        if symbol != "x":
            if g in _KEEP[symbol.lower()]:
                to = _KEEP[symbol.lower()][g]
                choices.append((late + node.costs[to], "K", node.ranks[to], to))
            to = _MADE[g]
            choices.append((3 + late + node.costs[to], "R", node.ranks[to], to))
        best.append(min(choices))
    for _ in range(3):  # rows are inserted at most three in a row before the same state comes back
        best = [min(best[g], (3 + best[_MADE[g]][0], "I", 0, _MADE[g])) for g in range(4)]

    def key(g: int) -> tuple:
        _, letter, rank, to = best[g]
        return (letter, key(to)) if letter == "I" else (letter, rank)

    low = min(b[0] for b in best)
    return Node(tuple(b[0] - low for b in best), _ranks([key(g) for g in range(4)])), low, [(b[1], b[3]) for b in best]


class Classes:
    """All classes that any row in front of the end leads to: tables by (class, symbol)."""

    def __init__(self):
        known, nodes = {(END.costs, END.ranks): 0}, [END]
        front, cost, edits = [], [], []
        for node in nodes:
            row = []
            for symbol in SYMBOLS:
                new, low, choice = _before(node, symbol)
                at = known.setdefault((new.costs, new.ranks), len(nodes))
                if at == len(nodes):
                    nodes.append(new)
                row.append((at, low, choice))
            front.append([r[0] for r in row])
            cost.append([r[1] for r in row])
            edits.append([r[2] for r in row])
        self.nodes, self.front, self.cost, self.edits = nodes, front, cost, edits
        after = [[[self._behind(e, g)[1] for g in range(4)] for e in row] for row in edits]
        self.front_of, self.cost_of, self.after = np.array(front, np.int32), np.array(cost, np.int64), np.array(after, np.int8)

    @staticmethod
    def _behind(choice: list[tuple[str, int]], g: int) -> tuple[str, int]:
        """The letters up to and with the row's own, and the state behind it."""
        letters = ""
        while True:
            letter, g = choice[g]
            letters += letter
            if letter != "I":
                return letters, g


@cache
def classes() -> Classes:
    return Classes()


def transfer(signature: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every class behind a piece: the class in front, the cost taken off, and the state behind it for each state in front."""
    c = classes()
    at = np.arange(len(c.nodes), dtype=np.int32)
    cost, state = np.zeros(len(at), np.int64), np.tile(np.arange(4, dtype=np.int8), (len(at), 1))
    for letter in reversed(signature):
        s = SYMBOLS.index(letter)
        state = np.take_along_axis(state, c.after[at, s].astype(np.int64), 1)
        cost = cost + c.cost_of[at, s]
        at = c.front_of[at, s]
    return at, cost, state


def _pieces(conv_type: pa.DataType, limit: int):
    """Signature pieces of rows sorted by conversation, turn, role and digest."""
    out_schema = pa.schema([
        ("conv_id", conv_type), ("part", pa.int32()), ("piece", pa.int64()), ("signature", pa.string()), ("edge", pa.bool_()), ("first", pa.string()),
        ("last", pa.string()), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("front", pa.binary()), ("state", pa.binary()),
    ])
    nothing = object()

    def run(batches):
        part = TaskContext.get().partitionId()
        done, held, number, first_conv, conv = [], None, 0, True, nothing

        def new():
            return {"letters": [], "n": 0, "first": None, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                    "n_turns": 0, "least": None, "most": None, "turn": None}

        def close(edge):
            nonlocal number
            p, signature = held, "".join(held["letters"])
            front = state = None
            if edge:
                at, _, to = transfer(signature)
                front, state = at.astype("<i4").tobytes(), to.tobytes()
            done.append((conv, part, number, signature, edge, p["first"], p["last"], [p["blank"], p["duplicate"], p["truncated"], p["illegal"], p["n_turns"]],
                         [p["least"], p["most"]], front, state))
            number += 1

        def flush():
            rows = list(zip(*done, strict=True)) if done else [()] * len(out_schema)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, out_schema, strict=True)], schema=out_schema)

        cut = False  # the conversation at hand has an earlier piece in this partition
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "kind", "seen", "n")]
            for c, turn, role, kind, seen, n in zip(*columns, strict=True):
                if held is None or c != conv:
                    if held is not None:
                        close(first_conv or cut)
                        first_conv = False
                    held, conv, cut = new(), c, False
                initial = role[:1]
                left = n
                while left:
                    if held["n"] >= limit:
                        close(True)
                        held, cut = new(), True
                    take = min(left, limit - held["n"])
                    fresh = left == n and not seen
                    if held["first"] is None:
                        held["first"] = initial
                    else:
                        held["illegal"] += held["last"] + initial not in ("su", "ua", "au")
                    held["illegal"] += take - 1  # no pair of equal initials is legal
                    held["last"] = initial
                    if kind == 1:
                        held["blank"] += take
                        held["letters"].append("x" * take)
                    else:
                        held["duplicate"] += take - fresh
                        held["truncated"] += fresh and kind == 2
                        letter = initial if initial in ("s", "u", "a") else "o"
                        held["letters"].append(((letter.upper() if kind == 2 else letter) if fresh else "x") + "x" * (take - 1))
                    held["n"] += take
                    left -= take
                if turn is not None:
                    if turn != held["turn"]:
                        held["n_turns"] += 1
                    held["turn"] = turn
                    held["least"] = turn if held["least"] is None else held["least"]
                    held["most"] = turn
            if len(done) >= 2000:
                yield flush()
        if held is not None:
            close(True)
        yield flush()

    return run


def _chain(batches):
    """For every piece of a cut conversation: the class behind it and the grammar state in front of it."""
    held, conv, first = [], None, True

    def solve():
        behind, state, out = [0] * len(held), START, []
        for k in range(len(held) - 1, 0, -1):
            behind[k - 1] = int(np.frombuffer(held[k][2], "<i4")[behind[k]])
        for (part, piece, _, to), b in zip(held, behind, strict=True):
            out.append((part, piece, b, state, part == held[-1][0] and piece == held[-1][1]))
            state = int(np.frombuffer(to, np.int8).reshape(-1, 4)[b, state])
        return out

    def batch_of(rows):
        parts = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [("part", pa.int32()), ("piece", pa.int64()), ("behind", pa.int32()), ("state", pa.int32()), ("last_piece", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(parts, kinds, strict=True)], schema=pa.schema(kinds))

    done = []
    for batch in batches:
        for c, part, piece, front, to in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "piece", "front", "state")), strict=True):
            if not first and c != conv:
                done += solve()
                held = []
            conv, first = c, False
            held.append((part, piece, front, to))
        yield batch_of(done)
        done = []
    if held:
        done += solve()
    yield batch_of(done)


class Solver:
    """Cost and audit of signatures; what a signature shares with the one before it, from the end, is not solved again."""

    def __init__(self):
        self.tables, self.path, self.kind = classes(), "", None
        self.at: list[int] = []
        self.costs: list[int] = []
        self.visited = 0

    def solve(self, signature: str, behind: int, state: int, last: bool) -> tuple[int, str]:
        t, turned = self.tables, signature[::-1]
        if self.kind != behind:
            self.path, self.kind, self.at, self.costs = "", behind, [behind], [0]
        common = len(commonprefix([self.path, turned]))
        del self.at[common + 1 :], self.costs[common + 1 :]
        for letter in turned[common:]:
            s, a = SYMBOLS.index(letter), self.at[-1]
            self.at.append(t.front[a][s])
            self.costs.append(self.costs[-1] + t.cost[a][s])
            self.visited += 1
        self.path = turned
        cost, letters, g = self.costs[-1] + t.nodes[self.at[-1]].costs[state], [], state
        for depth in range(len(signature), 0, -1):
            more, g = t._behind(t.edits[self.at[depth - 1]][SYMBOLS.index(turned[depth - 1])], g)
            letters.append(more)
        if last:
            letters.append({SYSTEM: "II", USER: "I"}.get(g, ""))
        else:
            cost -= t.nodes[behind].costs[g]
        return cost, "".join(letters)


def _solve(batches):
    solver = Solver()
    for batch in batches:
        got = [solver.solve(*row) for row in zip(*(batch.column(k).to_pylist() for k in ("signature", "behind", "state", "last_piece")), strict=True)]
        names = ["signature", "behind", "state", "last_piece", "salt"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in names], pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string())], names=[*names, "cost", "audit"]
        )


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults drawn by crc32 of ``conv_id:turn``: dropped, emptied, unfinished, repeated, reroled."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(rows).withColumn("_draw", F.crc32(key.cast("binary")) % 20).where("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def plain(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def fault_kind(text: Column) -> Column:
    """1 blank, 2 truncated, 0 neither."""
    last = F.right(F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", ""), F.lit(1))
    return F.when(~text.rlike(SOUND), 1).when(~last.isin(".", "!", "?"), 2).otherwise(0)


def solved_pieces(rows: DataFrame, limit: int = PIECE) -> DataFrame:
    """Pieces of conversations in order, with counts and audits; ``rows`` as from :func:`plain`."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.int64() if conv == "bigint" else pa.int32() if conv == "int" else pa.string()
    units = stored(rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), fault_kind(F.col("text")).alias("kind"))
                   .groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.count("*").alias("n")))
    # A row was seen before where its role and text have an earlier turn; repeats within a turn are counted by n.
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = units.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(when).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    units = units.join(firsts, same).select("conv_id", "turn", "role", "digest", "kind", "n", (~when.eqNullSafe(F.col("_first"))).alias("seen"))
    order = ["conv_id", "turn", "role", "digest"]
    schema = (f"conv_id {conv}, part int, piece long, signature string, edge boolean, first string, last string, counts array<long>, "
              "turns array<long>, front binary, state binary")
    ordered = stored(units).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(ordered.mapInArrow(_pieces(arrow, limit), schema))
    whole = pieces.where("not edge").drop("front", "state").withColumns({"behind": F.lit(0), "state": F.lit(START), "last_piece": F.lit(True)})
    edges = pieces.where("edge").select("conv_id", "part", "piece", "front", "state")
    chained = edges.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(
        _chain, "part int, piece long, behind int, state int, last_piece boolean"
    )
    cut = whole.unionByName(pieces.where("edge").drop("front", "state").join(chained, ["part", "piece"]))
    cut = stored(cut.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")))
    key = ["signature", "behind", "state", "last_piece", "salt"]
    nodes = cut.select(*key).distinct()
    near = [F.col("behind"), F.reverse("signature"), F.col("state"), F.col("last_piece"), F.col("salt")]
    audits = nodes.repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(
        _solve, "signature string, behind int, state int, last_piece boolean, salt int, cost long, audit string"
    )
    return cut.join(audits, key).select("conv_id", "part", "piece", "first", "last", "counts", "turns", "cost", "audit")


class _Walk:
    """One conversation as it streams by: its pieces, then its rows."""

    def __init__(self, sink: Callable[[str, str, str], None]):
        self.sink = sink
        self.audits: list[str] = []
        self.audit, self.at, self.state = None, 0, START
        self.counts, self.cost, self.last = [0] * 5, 0, None
        self.least = self.most = None

    def piece(self, first: str, last: str, counts: list[int], turns: list, cost: int, audit: str) -> None:
        blank, duplicate, truncated, illegal, n_turns = counts
        illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
        if self.most is not None and turns[0] == self.most:
            n_turns -= 1  # a turn that the piece before already has
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal, n_turns), strict=True)]
        self.least = turns[0] if self.least is None else self.least
        self.most = self.most if turns[1] is None else turns[1]
        self.last, self.cost = last, self.cost + cost
        self.audits.append(audit)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _MADE[self.state]
            self.sink("I", _NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.audit = "".join(self.audits) if self.audit is None else self.audit
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K":
            self.state = _KEEP[role[:1]][self.state]
        else:
            self.state = _MADE[self.state]
            role = _NAMES[self.state]
        self.sink(edit, role, text)

    def end(self) -> list:
        self.audit = "".join(self.audits) if self.audit is None else self.audit
        self._inserted()
        blank, duplicate, truncated, illegal, n_turns = self.counts
        gaps = 0 if self.least is None else self.most - self.least + 1 - n_turns
        return [gaps, blank, duplicate, truncated, illegal, self.cost, self.audit]


def _streamed(batches, sink_of: Callable) -> Iterator[tuple]:
    """(conversation, walk) of every conversation whose records pass by in order."""
    conv, walk = None, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text", "first", "last", "counts", "turns", "cost", "audit")]
        for c, kind, role, text, first, last, counts, turns, cost, audit in zip(*columns, strict=True):
            if walk is None or c != conv:
                if walk is not None:
                    yield conv, walk
                conv, walk = c, _Walk(sink_of(c))
            if kind == 1:
                walk.piece(first, last, counts, turns, cost, audit)
            elif kind == 2:
                walk.row(role, text)
        yield None, None
    if walk is not None:
        yield conv, walk


def _digests(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        sums = {}

        def sink_of(conv):
            total, empty = hashlib.sha256(), True
            sums["now"] = total

            def sink(_, role, text):
                nonlocal empty
                total.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

            sink.total = total
            return sink

        done = []
        for conv, walk in _streamed(batches, sink_of):
            if walk is not None:
                row = walk.end()
                done.append((conv, *row, walk.sink.total.hexdigest()))
            elif len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def _repaired(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        rows = []

        def sink_of(conv):
            place = -1

            def sink(edit, role, text):
                nonlocal place
                place += 1
                rows.append((conv, place, edit, role, text))

            return sink

        def flush():
            parts = list(zip(*rows, strict=True)) if rows else [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(parts, schema, strict=True)], schema=schema)

        for _, walk in _streamed(batches, sink_of):
            if walk is not None:
                walk.end()
            elif rows:
                yield flush()
        if rows:
            yield flush()

    return run


def _records(rows: DataFrame, conversations: DataFrame | None, limit: int) -> tuple[DataFrame, str, pa.DataType]:
    """Ids, pieces and rows of every conversation, in this order, one conversation after the other."""
    rows = plain(rows)
    conv = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.int64() if conv == "bigint" else pa.int32() if conv == "int" else pa.string()
    pieces = solved_pieces(rows, limit).withColumn("kind", F.lit(1))
    texts = rows.withColumns({"kind": F.lit(2), "digest": F.md5("text")})
    records = pieces.unionByName(texts, allowMissingColumns=True)
    if conversations is not None:
        records = records.unionByName(conversations.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = ["conv_id", "kind", "part", "piece", "turn", "role", "digest"]
    columns = ["conv_id", "kind", "role", "text", "first", "last", "counts", "turns", "cost", "audit"]
    return records.repartition("conv_id").sortWithinPartitions(*order).select(*columns), conv, arrow


def repair_report(rows: DataFrame, conversations: DataFrame | None = None, limit: int = PIECE) -> DataFrame:
    """One row per conversation: faults, cost and audit of the cheapest repair, and the digest of the repaired conversation.

    ``conversations`` names ids that are reported even without rows.  ``limit``
    is the longest piece of a signature.  The digest of a conversation is one
    stream by its nature: one task reads its rows, without holding them.
    """
    records, conv, arrow = _records(rows, conversations, limit)
    return records.mapInArrow(
        _digests(arrow), f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def repaired_conversations(rows: DataFrame, limit: int = PIECE) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, edit (K, R or I), role, text."""
    records, conv, arrow = _records(rows, None, limit)
    return records.mapInArrow(_repaired(arrow), f"conv_id {conv}, place long, edit string, role string, text string")
