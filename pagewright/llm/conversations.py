"""Repair of the role structure of conversations by a generalised LR parse.

The grammar is Chat -> (empty) | Turns | s Turns, Turns -> u a | u a Turns over the initials of roles. Its LR automaton has four
states. A conversation's rows stream through a graph-structured stack: per row each stack top may delete the row, keep it, or
rerole it, with inserted turns before it where the automaton needs them, and equal stack tops are merged into the one with the
smallest (cost, audit). Each top carries the digest of what it has emitted, so one pass decides and hashes.

An insertion is only made where the next kept row, or the end, needs it: an insertion that stands before a deleted row costs the
same behind it and has the greater audit. So the audits of two tops never are prefixes of each other, and comparing them is
comparing their parents' places, then their last letters.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import stored

#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Productions of the role grammar.
GRAMMAR = {"Chat": ("", "T", "sT"), "T": ("ua", "uaT")}

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def automaton(grammar: dict[str, tuple[str, ...]]) -> tuple[list[dict[str, int]], list[bool]]:
    """States of a right-linear grammar: where each initial leads from each, and whether a chat may end there."""

    def closure(items: set[str]) -> frozenset[str]:
        """What may still follow, as sequences whose last sign may be a name; names at the front are replaced by their rules."""
        todo, done = list(items), set()
        while todo:
            x = todo.pop()
            if x not in done:
                done.add(x)
                if x[:1] in grammar:
                    todo += [r + x[1:] for r in grammar[x[:1]]]
        return frozenset(x for x in done if x[:1] not in grammar)

    states, moves = [closure(set(grammar["Chat"]))], []
    for state in states:
        to: dict[str, set[str]] = {}
        for x in state:
            if x:
                to.setdefault(x[0], set()).add(x[1:])
        moves.append({})
        for initial, items in sorted(to.items()):
            if (nxt := closure(items)) not in states:
                states.append(nxt)
            moves[-1][initial] = states.index(nxt)
    return moves, ["" in s for s in states]


MOVES, ENDS = automaton(GRAMMAR)


def _inserts(state: int) -> dict[str, str]:
    """The fewest inserted user and assistant turns after which a state accepts an initial, or the end ('')."""
    found: dict[str, str] = {}
    seen, todo = {state}, [(state, "")]
    for at, made in todo:
        for initial in [*MOVES[at], *([""] if ENDS[at] else [])]:
            found.setdefault(initial, made)
        for initial in ROLES:
            to = MOVES[at].get(initial)
            if to is not None and to not in seen:
                seen.add(to)
                todo.append((to, made + initial))
    return found


def _options() -> list[list[tuple[str, str, str, int]]]:
    """For each state: (initial that the row then has, inserted initials before it, audit letters but the last, next state)."""
    out = []
    for state in range(len(MOVES)):
        rows = []
        for initial, made in _inserts(state).items():
            at = state
            for x in made:
                at = MOVES[at][x]
            if initial:
                rows.append((initial, made, "I" * len(made), MOVES[at][initial]))
        out.append(rows)
    return out


OPTIONS = _options()
AT_END = [_inserts(s)[""] for s in range(len(MOVES))]


class Top:
    """A stack top: its cost, its place among the tops by audit, and the digest and number of what was emitted below it."""

    __slots__ = ("cost", "place", "sha", "count")

    def __init__(self, cost: int, place: int, sha, count: int) -> None:
        self.cost, self.place, self.sha, self.count = cost, place, sha, count

    def emit(self, inserted: str, line: str | None):
        """The digest with inserted turns and a line behind what is below."""
        sha, count = self.sha.copy(), self.count
        for x in [f"{ROLES[i]}:" for i in inserted] + ([] if line is None else [line]):
            sha.update((f"\n{x}" if count else x).encode("utf-8", "surrogatepass"))
            count += 1
        return sha, count


#: Steps of the trace: a letter code and the parent state, five bits for each state.
LETTERS = ["D", "K", "R", "IK", "IR", "IIK", "IIR"]
CODES = {x: i for i, x in enumerate(LETTERS)}


class Parse:
    """The graph-structured stack of one conversation; four bytes a row are held for the audit, and one top for each state."""

    def __init__(self) -> None:
        self.tops: dict[int, Top] = {0: Top(0, 0, hashlib.sha256(), 0)}
        self.trace = array("I")

    def delete(self) -> None:
        step = 0
        for state, top in self.tops.items():
            top.cost += DELETE
            step |= (CODES["D"] << 2 | state) << 5 * state
        self.trace.append(step)

    def row(self, role: str, text: str, truncated: bool) -> None:
        """A row that may stay, be reroled or be deleted."""
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, place: int, letters: str, parent: int, inserted: str, to: str | None) -> None:
            mine = (cost, place, letters, parent, inserted, to)
            if state not in best or mine[:3] < best[state][:3]:
                best[state] = mine

        extra = TRUNCATED if truncated else 0
        for state, top in self.tops.items():
            offer(state, top.cost + DELETE, top.place, "D", state, "", None)
            for initial, inserted, letters, to in OPTIONS[state]:
                cost = top.cost + INSERT * len(inserted) + extra
                if role[:1] == initial:
                    offer(to, cost + KEEP, top.place, letters + "K", state, inserted, role)
                if initial in ROLES:
                    offer(to, cost + REROLE, top.place, letters + "R", state, inserted, ROLES[initial])
        order = {x: i for i, x in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        tops, step = {}, 0
        for state, (cost, _, letters, parent, inserted, to) in best.items():
            below = self.tops[parent]
            sha, count = (below.sha, below.count) if to is None else below.emit(inserted, f"{to}:{text}")
            tops[state] = Top(cost, order[state], sha, count)
            step |= (CODES[letters] << 2 | parent) << 5 * state
        self.tops = tops
        self.trace.append(step)

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair; of several, the one with the least audit."""
        ends = [(top.cost + INSERT * len(AT_END[s]), top.place, "I" * len(AT_END[s]), s) for s, top in self.tops.items()]
        cost, _, letters, state = min(ends)
        sha, _ = self.tops[state].emit(AT_END[state], None)
        audit = [letters]
        for step in reversed(self.trace):
            x = step >> 5 * state & 31
            audit.append(LETTERS[x >> 2])
            state = x & 3
        return cost, "".join(reversed(audit)), sha.hexdigest()


class Faults:
    """What the contract counts in one conversation, row by row in order, together with its parse."""

    def __init__(self) -> None:
        self.parse = Parse()
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        """Equal rows of one turn; `first`: no earlier turn has them."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        bare = text.rstrip(BLANKS)
        if not bare:
            self.blank += copies
            gone = copies
        else:
            gone = copies - 1 if first else copies
            self.duplicate += gone
        if gone < copies:
            cut = bare[-1] not in ".!?"
            self.truncated += cut
            self.parse.row(role, text, cut)
        for _ in range(gone):
            self.parse.delete()
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.before = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.parse.result()


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with the damage that crc32(`conv_id:turn`) % 20 chooses.

    0: no copies (the row only stands for its conversation); 1: an empty text; 2: no `[.!?]`; 3: two copies; 4: role user. A null
    is one space, in the key as in role and text; conv_id and turn themselves stay null.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")), F.lit(20))
    x = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), draw.alias("draw"), part("role").alias("role"), part("text").alias("text"))
    gone = F.col("draw") == 0
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return x.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))).alias("role"),
                    F.when(~gone, text).alias("text"), F.when(gone, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of each conversation one behind the other: by turn (nulls first), then role and text, equal ones as one row.

    Equal rows are counted before they move. `first` says that no earlier turn has the role and text; that is found by a minimum
    per (conversation, role, text) and a join, so no task gathers such a group.
    """
    keys = ["conv_id", "turn", "role", "text"]
    few = stored(rows.groupBy(*keys).agg(F.sum("copies").alias("copies")).withColumn("mark", F.sha2("text", 256)))
    earliest = few.filter("copies > 0").groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("earliest"))
    a, b = few.alias("a"), earliest.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.mark") == F.col("b.mark"))
    told = a.join(b, same, "left").select(*[f"a.{c}" for c in keys], "a.copies", F.col("a.turn").eqNullSafe(F.col("b.earliest.turn")).alias("first"))
    # by a hash, as Spark leaves out a shuffle on columns that a join before it used
    return told.repartition(F.xxhash64("conv_id")).sortWithinPartitions(*keys)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key: list = []
    made: list[tuple] = []
    now = Faults()
    for batch in batches:
        for conv, turn, role, text, copies, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "first"))):
            if key != [conv]:
                if key:
                    made.append((key[0], *now.row()))
                key, now = [conv], Faults()
            if copies:
                now.add(turn, role, text, copies, first)
        if len(made) > 1000:
            yield _batch(made)
            made = []
    if key:
        made.append((key[0], *now.row()))
    if made:
        yield _batch(made)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.string()) for c in columns[7:]], NAMES)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and audit of the cheapest edits, and the digest of the repaired turns.

    rows: conv_id, turn, role, text, copies (0: the row only stands for its conversation), as `damaged` gives them; role and text
    without nulls where there are copies. A null conv_id is one conversation. Rows of one turn that differ are taken by role, then
    text. A conversation's rows pass through one task, as its digest has to be made in order; they are sorted on disk and stream,
    and four bytes a row are held. Other columns are not read.
    """
    return ordered(rows).mapInArrow(_stream, RESULT)


def turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), role, text, edit (K, R or I), from the audits of `repair`."""
    lines = ordered(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("copies"), "audit")
    both = heads.union(lines).repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = None
        at = state = place = 0
        for batch in batches:
            made: list[tuple] = []

            def insert() -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    initial = next(i for i in ROLES if i in MOVES[state])
                    made.append((conv, place, ROLES[initial], "", "I"))
                    at, state, place = at + 1, MOVES[state][initial], place + 1

            for head, role, text, copies, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "audit"))):
                if told is not None:
                    conv, audit, at, state, place = head, told, 0, 0, 0
                    insert()
                for _ in range(copies):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        initial = role[:1] if edit == "K" else next(i for i in ROLES if i in MOVES[state])
                        made.append((conv, place, role if edit == "K" else ROLES[initial], text, edit))
                        state, place = MOVES[state][initial], place + 1
                    insert()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text", "edit"])

    return both.mapInArrow(apply, "conv_id bigint, place bigint, role string, text string, edit string")


def digest(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
