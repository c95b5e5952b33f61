"""Cheapest repair of the turn structure of conversations, by Four-Russians block tables.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. An automaton of four
states reads it; the cost to finish from each state is a vector of four numbers, and reading one
turn backwards turns one vector into another. Up to a constant only few vectors exist, so the
transition for every block of ``BLOCK`` turn symbols is tabulated once from them. A
conversation is read backwards block by block with one lookup each; then the edits are read
forwards, expanding each block backwards from the vector at its right end, and taking of the
cheapest edits always the one with the smallest letter.

Turns are sorted by ranges of (conversation, turn), so that a long conversation may lie in several
partitions. What is carried over a border is a 4 x 4 cost matrix and a state, for at most two
conversations of a partition; a task holds the turns of one conversation in its partition.

Faults of a turn, the first counts: blank (no word), duplicate (its role and text were seen
earlier in the conversation), truncated (does not end in ``.``, ``!`` or ``?``).

Edits: Keep, Rerole (to user or assistant), Delete (required for blank and duplicate), Insert (an
empty turn). Ties between turns of one number are in the order of role, then hash of the text;
equal turns are counted, not repeated. Null roles and texts are read as one space, a null turn
comes first, a null conversation is one conversation. A turn whose role is empty has no initial
and cannot be kept. A conversation without turns has zero counts and an empty audit, a table
without rows gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import BLANKS
from citelode.session import cut_lineage

#: Symbols of a turn: initial s, u, a or another, plus 4 where truncated; 8 where it has to go.
INITIALS, TRUNCATED, GONE, SYMBOLS = "sua", 4, 8, 9
#: State after each initial: start, after s, after u, after a. None: not allowed.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that may follow in each state, and the state after it.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ACCEPTING = (0, 3)
STATES = 4
#: Turns of a block.
BLOCK = 4
FAR = 1_000_000_000


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Tables:
    """Normalised cost vectors, and their transitions for one turn and for a block of turns."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        ends = [tuple(0 if s in ACCEPTING else FAR for s in range(STATES))]
        ends += [tuple(0 if s == e else FAR for s in range(STATES)) for e in range(STATES)]
        self.end, *self.at_state = (self._id(self._inserted(end))[0] for end in ends)
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):
            vector = self.vectors[len(steps)]
            steps.append([self._id(self._before(vector, symbol)) for symbol in range(SYMBOLS)])
        self.step_to = np.array([[to for to, _ in row] for row in steps])
        self.step_cost = np.array([[cost for _, cost in row] for row in steps])
        codes = np.arange(SYMBOLS ** BLOCK)
        to = np.repeat(np.arange(len(steps))[:, None], len(codes), axis=1)
        cost = np.zeros_like(to)
        for place in range(BLOCK):  # the last turn of a block is its lowest digit
            digit = codes // SYMBOLS ** place % SYMBOLS
            cost += self.step_cost[to, digit]
            to = self.step_to[to, digit]
        self.block_to, self.block_cost = to, cost
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _inserted(self, vector: tuple[int, ...]) -> tuple[int, ...]:
        best = list(vector)
        for _ in range(STATES):
            best = [min(best[s], self.costs.insert + best[NEXT_STATE[s]]) for s in range(STATES)]
        return tuple(min(x, FAR) for x in best)

    def _taken(self, symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Edits of a turn in a state, by letter: (letter, cost, state after)."""
        edits = [("D", self.costs.delete, state)]
        if symbol != GONE:
            more = self.costs.truncated if symbol >= TRUNCATED else 0
            initial = INITIALS[symbol % TRUNCATED:symbol % TRUNCATED + 1]
            kept = AFTER[initial][state] if initial else None
            if kept is not None:
                edits.append(("K", more, kept))
            edits.append(("R", self.costs.rerole + more, NEXT_STATE[state]))
        return edits

    def _before(self, vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        return self._inserted(tuple(
            min(FAR, *(cost + vector[to] for _, cost, to in self._taken(symbol, state))) for state in range(STATES)
        ))

    def _id(self, vector: tuple[int, ...]) -> tuple[int, int]:
        least = min(vector)
        plain = tuple(x - least if x < FAR // 2 else FAR for x in vector)
        if plain not in self.ids:
            self.ids[plain] = len(self.vectors)
            self.vectors.append(plain)
        return self.ids[plain], least

    def known(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """Number of a vector that has been tabulated, and what was taken off."""
        least = min(vector)
        return self.ids[tuple(x - least if x < FAR // 2 else FAR for x in vector)], least

    def _blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """The turns before the first whole block, and the codes of the blocks."""
        head = len(symbols) % BLOCK
        weights = SYMBOLS ** np.arange(BLOCK)[::-1]
        return symbols[:head].tolist(), (symbols[head:].reshape(-1, BLOCK) @ weights).tolist()

    def backward(self, symbols: np.ndarray, right: int) -> tuple[int, int, list[int]]:
        """From the vector at the right end: the vector at the left end, its constant, and the
        vectors right of the first turns and of every block."""
        head, codes = self._blocks(symbols)
        cost, now, seen = 0, right, []
        for code in reversed(codes):
            seen.append(now)
            cost += int(self.block_cost[now, code])
            now = int(self.block_to[now, code])
        seen.reverse()
        middle = now
        for symbol in reversed(head):
            cost += int(self.step_cost[now, symbol])
            now = int(self.step_to[now, symbol])
        return now, cost, [middle, *seen]

    def matrix(self, symbols: np.ndarray) -> list[int]:
        """Least costs from each state before the turns to each state after them, row by row."""
        columns = []
        for state in range(STATES):
            left, cost, _ = self.backward(symbols, self.at_state[state])
            columns.append([min(FAR, x + cost) for x in self.vectors[left]])
        return [columns[to][start] for start in range(STATES) for to in range(STATES)]

    def audit(self, symbols: np.ndarray, right: int, state: int, last: bool) -> tuple[str, int, int]:
        """Letters of the cheapest edits from a state, their cost to the end of the conversation
        without the constant of ``right``, and the state after them."""
        left, cost, seen = self.backward(symbols, right)
        cost += self.vectors[left][state]
        head, codes = self._blocks(symbols)
        letters, state = self._expand(tuple(head), seen[0], state)
        parts = [letters]
        for code, vector in zip(codes, seen[1:]):
            key = (code, vector, state)
            if key not in self.traced:
                digits = tuple(code // SYMBOLS ** place % SYMBOLS for place in reversed(range(BLOCK)))
                self.traced[key] = self._expand(digits, vector, state)
            letters, state = self.traced[key]
            parts.append(letters)
        while last and self.vectors[right][state] > 0:
            parts.append("I")
            state = NEXT_STATE[state]
        return "".join(parts), cost, state

    def _expand(self, symbols: tuple[int, ...], right: int, state: int) -> tuple[str, int]:
        """Costs before every turn of a block, backwards; then the smallest letters, forwards."""
        before = [self.vectors[right]]
        for symbol in reversed(symbols):
            before.append(self._before(before[-1], symbol))
        before.reverse()
        letters = []
        for place, symbol in enumerate(symbols):
            while True:
                now, rest = before[place], before[place + 1]
                edits = self._taken(symbol, state)
                edits.append(("I", self.costs.insert + now[NEXT_STATE[state]] - rest[NEXT_STATE[state]], NEXT_STATE[state]))
                letter, _, state = min(x for x in edits if x[1] + rest[x[2]] == now[state])
                letters.append(letter)
                if letter != "I":
                    break
        return "".join(letters), state


@lru_cache(maxsize=4)
def tables(costs: Costs) -> Tables:
    return Tables(costs)


def repaired(turns: list[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """The turns after the edits."""
    at = iter(turns)
    for letter in letters:
        if letter == "I":
            yield NEXT_ROLE[state], ""
            state = NEXT_STATE[state]
            continue
        role, text = next(at)
        if letter == "K":
            yield role, text
            state = AFTER[role[:1]][state]
        elif letter == "R":
            yield NEXT_ROLE[state], text
            state = NEXT_STATE[state]


def damage(conversations: DataFrame) -> DataFrame:
    """Faults put in by a checksum of ``conv_id:turn``: ``conv_id, turn, role, text, times``."""
    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select("conv_id", "turn", "role", text.alias("text"), kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def marked(turns: DataFrame) -> DataFrame:
    """Each different turn of a conversation once, with the symbol of its first occurrence and how
    many follow it in its place: ``conv_id, turn, role, text, hash, symbol, times, blank, first``."""
    hashed = turns.withColumns({"hash": F.sha2("text", 256), "known": F.col("turn").isNotNull(), "place": F.coalesce("turn", F.lit(0))})
    each = hashed.groupBy("conv_id", "known", "place", "role", "hash").agg(
        F.first("turn").alias("turn"), F.first("text").alias("text"), F.sum("times").alias("times")
    )
    firsts = hashed.groupBy("conv_id", "role", "hash").agg(F.min(F.struct("known", "place")).alias("at")).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash"),
        F.col("at.known").alias("_known"), F.col("at.place").alias("_place"),
    )
    met = each["conv_id"].eqNullSafe(firsts["_conv"]) & (each["role"] == firsts["_role"]) & (each["hash"] == firsts["_hash"])
    met &= (each["known"] == firsts["_known"]) & (each["place"] == firsts["_place"])
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    ended = F.right(core, F.lit(1)).isin(".", "!", "?")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    number = F.when((F.length("role") > 0) & (initial >= 0), initial).otherwise(len(INITIALS))
    return each.join(firsts, met, "left").select(
        "conv_id", "known", "place", "turn", "role", "hash", "text", "times",
        (core == "").alias("blank"), F.col("_hash").isNotNull().alias("first"),
        F.when((core == "") | F.col("_hash").isNull(), GONE).otherwise(number + F.when(ended, 0).otherwise(TRUNCATED)).cast("int").alias("symbol"),
    )


@dataclass
class Stretch:
    """The turns of one conversation that lie in one partition."""

    conv: object
    turns: list[tuple[str, str, int, int, bool, bool]]

    def symbols(self) -> np.ndarray:
        out = bytearray()
        for _, _, symbol, times, _, _ in self.turns:
            out.append(symbol)
            out.extend(bytes([GONE]) * (times - 1))
        return np.frombuffer(bytes(out), dtype=np.uint8).astype(np.int64)

    def rows(self) -> list[tuple[str, str]]:
        return [(role, text) for role, text, _, times, _, _ in self.turns for _ in range(times)]

    def counts(self, previous: str | None) -> tuple[int, int, int, int]:
        """Blank, duplicate and truncated turns, and neighbours whose initials do not fit."""
        blank = duplicate = truncated = illegal = 0
        for role, _, symbol, times, is_blank, first in self.turns:
            if is_blank:
                blank += times
            else:
                duplicate += times - first
                truncated += TRUNCATED <= symbol < GONE
            initial = role[:1]
            if previous is not None and previous + initial not in ("su", "ua", "au"):
                illegal += 1
            illegal += times - 1
            previous = initial
        return blank, duplicate, truncated, illegal


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Stretch]]:
    """(partition, stretch) of sorted turns."""
    now: Stretch | None = None
    part = 0
    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("part", "conv_id", "role", "text", "symbol", "times", "blank", "first")]
        for part, conv, *turn in zip(*columns):
            if now is None or now.conv != conv:
                if now is not None:
                    yield part, now
                now = Stretch(conv, [])
            now.turns.append(tuple(turn))
    if now is not None:
        yield part, now


def _ends(sorted_turns: DataFrame, work: Callable[[int, Stretch], list | None], schema: str) -> list:
    """Rows of ``work`` for the first and the last conversation of every partition."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for last in stretches(batches):
            first = first or last
        out = [work(*x) for x in ([first] if first is last else [first, last]) if x is not None]
        out = [row for row in out if row is not None]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out])

    return sorted_turns.mapInArrow(run, schema).collect()


@dataclass(frozen=True)
class Border:
    """What a stretch of a conversation that spans partitions has to know of the others."""

    right: int
    rest: int
    state: int
    previous: str | None
    first: bool
    last: bool


def borders(sorted_turns: DataFrame, costs: Costs) -> dict[tuple[int, str], Border]:
    """For the stretches of conversations that lie in several partitions, by (partition, name).
    At most two rows a partition reach the driver."""

    def outline(part: int, stretch: Stretch) -> list:
        turns = stretch.turns
        return [part, repr(stretch.conv), turns[0][0][:1], turns[-1][0][:1], tables(costs).matrix(stretch.symbols())]

    known = _ends(sorted_turns, outline, "part long, name string, head string, tail string, costs array<long>")
    chains: dict[str, list] = {}
    for row in sorted(known, key=lambda row: row["part"]):
        chains.setdefault(row["name"], []).append(row)
    chains = {name: rows for name, rows in chains.items() if len({row["part"] for row in rows}) > 1}
    if not chains:
        return {}
    table = tables(costs)
    rights: dict[tuple[int, str], tuple[int, int]] = {}
    for name, rows in chains.items():
        vector = table.vectors[table.end]
        for row in reversed(rows):
            rights[row["part"], name] = table.known(vector)
            vector = tuple(min(row["costs"][STATES * s + e] + vector[e] for e in range(STATES)) for s in range(STATES))

    def moves(part: int, stretch: Stretch) -> list | None:
        if (part, repr(stretch.conv)) not in rights:
            return None
        right, _ = rights[part, repr(stretch.conv)]
        symbols, table = stretch.symbols(), tables(costs)
        left = table.vectors[table.backward(symbols, right)[0]]
        return [part, repr(stretch.conv), [
            table.audit(symbols, right, s, False)[2] if left[s] < FAR else -1 for s in range(STATES)
        ]]

    after = {(row["part"], row["name"]): row["after"] for row in _ends(sorted_turns, moves, "part long, name string, after array<long>")}
    found = {}
    for name, rows in chains.items():
        state, previous = 0, None
        for row in rows:
            key = (row["part"], name)
            found[key] = Border(*rights[key], state, previous, row is rows[0], row is rows[-1])
            state, previous = after[key][state], row["tail"]
    return found


def _digest(lines: Iterator[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def _long_digests(ready: DataFrame, met: dict[tuple[int, str], Border], costs: Costs) -> DataFrame:
    """Hash of the conversations that span partitions. A hash is read in order, so the repaired
    turns of one such conversation stream through one task, which holds none of them."""
    kind = ready.schema["conv_id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, batches = _conv_type(batches)
        for part, stretch in stretches(batches):
            border = met.get((part, repr(stretch.conv)))
            if border is None:
                continue
            letters, _, _ = tables(costs).audit(stretch.symbols(), border.right, border.state, border.last)
            kept = [f"{role}:{text}" for role, text in repaired(stretch.rows(), letters, border.state)]
            for start in range(0, len(kept), 1_000):
                some = kept[start:start + 1_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([stretch.conv] * len(some), type_), pa.array([part] * len(some), pa.int32()),
                    pa.array(range(start, start + len(some)), pa.int32()), pa.array(some, pa.string()),
                ], names=["conv_id", "part", "place", "line"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, batches = _conv_type(batches)
        done: list[tuple[object, str]] = []
        conv, running = None, None
        for batch in batches:
            for now, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist()):
                if running is not None and now == conv:
                    running.update(b"\n")
                else:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = now, hashlib.sha256()
                running.update(line.encode())
        if running is not None:
            done.append((conv, running.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], type_), pa.array([x[1] for x in done], pa.string())], names=["conv_id", "repaired_sha256"]
        )

    listed = ready.mapInArrow(lines, f"conv_id {kind}, part int, place int, line string")
    sorted_lines = listed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return sorted_lines.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def _conv_type(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """Arrow type of the conversation id, and the batches again."""
    first = next(batches, None)
    if first is None:
        return pa.null(), iter(())
    return first.schema.field("conv_id").type, chain([first], batches)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Of ``conv_id, turn, role, text, times``: for every ``conv_id`` of ``conversations`` its ``gaps, blank,
    duplicate, truncated, illegal, cost, audit`` and ``repaired_sha256``."""
    order = ["conv_id", "known", "place", "role", "hash"]
    ranged = marked(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    ready = cut_lineage(ranged.select(
        F.spark_partition_id().alias("part"), "conv_id", "role", "text", "symbol", "times", "blank", "first"
    ))
    met = borders(ready, costs)
    kind = ready.schema["conv_id"].dataType.simpleString()
    alone = Border(tables(costs).end, 0, 0, None, True, True)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, batches = _conv_type(batches)
        types = [type_, pa.int32(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(column, type_) for column, type_ in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", *COUNTS, "audit", "repaired_sha256"])

        for part, stretch in stretches(batches):
            border = met.get((part, repr(stretch.conv)), alone)
            letters, cost, _ = tables(costs).audit(stretch.symbols(), border.right, border.state, border.last)
            digest = _digest(repaired(stretch.rows(), letters, 0)) if border is alone else None
            counts = stretch.counts(border.previous)
            out.append((stretch.conv, part, *counts, cost + border.rest if border.first else 0, letters, digest))
            if len(out) == 2_000:
                yield flush()
                out = []
        if out:
            yield flush()

    numbers = ", ".join(f"{name} long" for name in COUNTS)
    pieces = ready.mapInArrow(judge, f"conv_id {kind}, part int, {numbers}, audit string, repaired_sha256 string")
    spans = turns.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps")
    )
    every = conversations.select("conv_id").distinct()
    rows = pieces.unionByName(spans, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    if met:
        rows = rows.unionByName(_long_digests(ready, met, costs), allowMissingColumns=True)
    letters = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))
    found = rows.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in ("gaps", *COUNTS)],
        F.array_join(F.transform(letters, lambda x: x["audit"]), "").alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return found.select("conv_id", "gaps", *COUNTS, "audit", "repaired_sha256")
