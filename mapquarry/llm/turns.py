"""Repair of conversation structure by a forward Viterbi program over four grammar states.

Roles must read ``(s?(ua)+)?``. A layer holds, for each grammar state (nothing yet, after the system turn, after a
user turn, after an assistant turn), the cheapest cost and the ASCII-least string of edits that lead there. Each turn
moves the layer by Keep, Rerole or Delete and closes it by at most two Inserts, more would only go in a circle.

Conversations are dealt by their id once. A window that uses the same partitioning marks the turns that were seen
before, a second local sort brings each conversation into its order, and a task streams over it: edits on which all
four states agree are final and leave memory, so a long conversation isn't held whole.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import sized

#: Costs of the edits, and of a truncated turn that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = "\t\n\x0b\x0c\r "
#: Grammar states.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after the turn with this initial, by the state before.
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that Rerole and Insert write in a state, with the state after it.
WRITES = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FAULTS = ("blank", "duplicate", "truncated")
#: Turns between two looks for edits that are final.
SETTLE = 64

_SUMMARY = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
_TURNS = ["conv_id", "place", "role", "text", "edit"]


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a turn: blank, duplicate (role and text seen earlier) or truncated."""
    core = text.rstrip(WHITE)
    return "blank" if not core else "duplicate" if seen else None if core[-1] in ".!?" else "truncated"


def closed(layer: list) -> list:
    """The layer with inserted turns: one into each state that another turn reaches, then one more."""
    for state, after in ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        if layer[state] is not None:
            cost, audit = layer[state]
            new = (cost + INSERT, audit + "I")
            if layer[after] is None or new < layer[after]:
                layer[after] = new
    # after an assistant turn all goes that goes before any turn, but for a system turn, which Delete takes away;
    # so states that cost more can't win, and leave so that the others may agree
    if layer[ASSISTANT] is not None:
        for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
            if layer[state] is not None and layer[state][0] > layer[ASSISTANT][0] + more:
                layer[state] = None
    return layer


def moved(layer: list, initial: str, found: str | None) -> list:
    """The layer after one more turn, not yet closed."""
    new: list = [None] * 4
    extra = TRUNCATED if found == "truncated" else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        steps = [(state, cost + DELETE, "D")]
        if found not in ("blank", "duplicate"):
            if (kept := NEXT.get(initial, {}).get(state)) is not None:
                steps.append((kept, cost + extra, "K"))
            steps.append((WRITES[state][1], cost + REROLE + extra, "R"))
        for after, price, letter in steps:
            if new[after] is None or (price, audit + letter) < new[after]:
                new[after] = (price, audit + letter)
    return new


class Conversation:
    """One conversation, fed turn by turn in order; ``out`` gathers repaired turns as (role, text, edit)."""

    def __init__(self) -> None:
        self.layer = closed([(0, ""), None, None, None])
        self.held: deque[tuple[str, str]] = deque()
        self.out: list[tuple[str, str, str]] = []
        self.state, self.fed = EMPTY, 0
        self.audit: list[str] = []
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.last = 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def feed(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        found = fault(text, seen)
        if found:
            self.counts[found] += 1
        self.layer = closed(moved(self.layer, role[:1], found))
        self.held.append((role, text))
        self.fed += 1
        if self.fed % SETTLE == 0:
            ways = [x[1] for x in self.layer if x]
            low, high = min(ways), max(ways)
            n = next((k for k, c in enumerate(low) if k >= len(high) or high[k] != c), len(low))
            self._settle(low[:n])
            self.layer = [x and (x[0], x[1][n:]) for x in self.layer]

    def _settle(self, edits: str) -> None:
        """Carry out edits that no later turn can change."""
        self.audit.append(edits)
        for letter in edits:
            role, text = ("", "") if letter == "I" else self.held.popleft()
            if letter == "D":
                continue
            if letter == "K":
                self.state = NEXT[role[:1]][self.state]
            else:
                role, self.state = WRITES[self.state]
            self.out.append((role, text, letter))

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest way that ends in the grammar."""
        cost, rest = min(x for x in (self.layer[EMPTY], self.layer[ASSISTANT]) if x is not None)
        self._settle(rest)
        return cost, "".join(self.audit)

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, conversation, whether it has ended) after each turn; every conversation ends once."""
    key, now = None, None
    for batch in batches:
        for conv, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != key:
                if now is not None:
                    yield key, now, True
                key, now = conv, Conversation()
            for again in range(copies):
                now.feed(turn, role, text, seen or again > 0)
            yield key, now, False
    if now is not None:
        yield key, now, True


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    digest, empty = hashlib.sha256(), True

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(_SUMMARY)
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _SUMMARY)

    for key, talk, over in _streams(batches):
        if over:
            cost, audit = talk.end()
        for role, text, _ in talk.out:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            empty = False
        talk.out.clear()
        if over:
            rows.append((key, talk.gaps(), *(talk.counts[f] for f in FAULTS), talk.illegal, cost, audit, digest.hexdigest()))
            digest, empty = hashlib.sha256(), True
            if len(rows) >= 1000:
                yield batch()
                rows.clear()
    yield batch()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    place = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(_TURNS)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _TURNS)

    for key, talk, over in _streams(batches):
        if over:
            talk.end()
        for role, text, edit in talk.out:
            rows.append((key, place, role, text, edit))
            place += 1
        talk.out.clear()
        if over:
            place = 0
        if len(rows) >= 1000:
            yield batch()
            rows.clear()
    yield batch()


def in_order(rows: DataFrame) -> DataFrame:
    """Turns by conversation and turn (nulls first), with ``seen``: whether an earlier turn has this role and text.

    ``rows(conv_id, turn, role, text)`` may hold ``copies``, how often a turn stands there (0: the conversation is
    known and the turn isn't). Turns of one number come by role and text, so that equal ones are neighbours.
    """
    sized(rows.sparkSession)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    plain = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies"),
    )
    order = [F.asc_nulls_first("turn"), F.desc("copies")]
    before = Window.partitionBy("conv_id", "role", "text", F.col("copies") > 0).orderBy(*order)
    marked = plain.repartition("conv_id").withColumn("seen", F.row_number().over(before) > 1)
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost and audit of its cheapest edits, digest of the repaired ``role:text`` lines.

    ``rows(conv_id, turn, role, text)``; a null role or text is one space, a null conv_id is a conversation like others.
    ``gaps`` are turn numbers missing between the first and the last (null numbers ignored), ``illegal`` neighbours
    whose initials don't follow each other in the grammar. Repeated rows are duplicates; other columns are ignored; an empty
    table gives none.
    """
    kinds = ["long"] * 7 + ["string"] * 2
    return in_order(rows).mapInArrow(_summaries, ", ".join(f"{n} {k}" for n, k in zip(_SUMMARY, kinds, strict=True)))


def repaired(rows: DataFrame) -> DataFrame:
    """The turns after ``repair``: conv_id, place from 0, role, text and the edit (K, R or I) that each comes from."""
    return in_order(rows).mapInArrow(_repaired, "conv_id long, place long, role string, text string, edit string")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that the CRC-32 of ``conv_id:turn`` picks, as input of ``repair``.

    Of 20 remainders 0 drops the turn (its conversation stays known), 1 empties it, 2 removes its sentence ends, 3
    repeats it and 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
