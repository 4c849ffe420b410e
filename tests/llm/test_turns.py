"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from mapquarry.llm import queries, turns

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    seen, out = set(), []
    for role, text in rows:
        core = re.sub("[ \t-\r]", "", text)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def searched(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Every way to edit, at most two insertions between turns."""
    found = faults(rows)
    best = None

    def go(k: int, cost: int, audit: str, out: tuple, inserted: int) -> None:
        nonlocal best
        if best and cost > best[0]:
            return
        initials = "".join(r[:1] for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials) or (out and not all(r for r, _ in out)):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 5, audit + "I", (*out, (role, "")), inserted + 1)
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, cost + 2, audit + "D", out, 0)
            if found[k] not in ("blank", "duplicate"):
                more = 5 if found[k] == "truncated" else 0
                go(k + 1, cost + more, audit + "K", (*out, (role, text)), 0)
                for to in ("user", "assistant"):
                    go(k + 1, cost + more + 1, audit + "R", (*out, (to, text)), 0)

    go(0, 0, "", (), 0)
    return best


def expected(rows: list[tuple], cost_of=searched) -> list[tuple]:
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            talks[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        found = faults([x[1:] for x in talk])
        numbers = [x[0] for x in talk if x[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        cost, audit, text = cost_of([x[1:] for x in talk])
        out.append((conv, gaps, *(found.count(f) for f in turns.FAULTS), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def talks(seed: int, n: int, most: int) -> list[tuple]:
    rnd = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "unknown", "", None]
    words = ["Yes.", "No!", "Why?", "cut", "", " \t\x0b", "a\nb.", "Ünï. ", "é", None]
    return [(c, t, rnd.choice(roles), rnd.choice(words)) for c in range(n) for t in rnd.sample([None, *range(9)], rnd.randint(1, most))]


def test_equals_a_search_over_all_edits(spark):
    rows = talks(1, 150, 6) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho."), (-1, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as seen", "2 as copies_").repartition(5)
    assert got(turns.repair(turns.damage(df))) == expected(rows)


@pytest.mark.parametrize("seed", range(40))
def test_any_rows_without_spark(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b.", "c", "d?", ""])) for _ in range(rnd.randint(0, 7))]
    talk = turns.Conversation()
    for k, ((role, text), found) in enumerate(zip(rows, faults(rows), strict=True)):
        talk.feed(k, role, text, found == "duplicate")
    cost, audit, text = searched(rows)
    assert talk.end() == (cost, audit)
    assert "\n".join(f"{r}:{t}" for r, t, _ in talk.out) == text


def test_a_long_conversation_leaves_memory_as_it_goes(monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.choice(["user", "assistant", "assistant", "tool"]), f"{k}{rnd.choice(['.', '', '!'])}") for k in range(3000)]

    def run(settle: int):
        monkeypatch.setattr(turns, "SETTLE", settle)
        talk, most = turns.Conversation(), 0
        for k, (role, text) in enumerate(rows):
            talk.feed(k, role, text, False)
            most = max(most, len(talk.held))
        return talk.end(), talk.out, most

    whole, settled = run(10**9), run(16)
    assert whole[:2] == settled[:2] and whole[2] == 3000 and settled[2] < 64


def test_edges(spark):
    def one(*rows):
        return [tuple(r) for r in turns.repair(spark.createDataFrame([(1, *r) for r in rows], SCHEMA)).collect()]

    nothing = hashlib.sha256(b"").hexdigest()
    assert turns.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert one((None, None, None)) == [(1, 0, 1, 0, 0, 0, 2, "D", nothing)]
    assert one((3, "user", "a."), (9, "assistant", "b."))[0][:8] == (1, 5, 0, 0, 0, 0, 0, "KK")
    assert one((0, "user", "a."), (1, "assistant", "a."), (2, "user", "a."), (3, "assistant", "a."))[0][1:8] == (0, 0, 2, 0, 0, 4, "KKDD")
    dropped = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    gone = turns.damage(spark.createDataFrame([(7, dropped, "user", "a.")], SCHEMA))
    assert got(turns.repair(gone)) == [(7, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_repaired_turns_give_the_digest(spark):
    rows = talks(2, 60, 9)
    df = turns.damage(spark.createDataFrame(rows, SCHEMA))
    told = {r["conv_id"]: r for r in turns.repair(df).collect()}
    texts = defaultdict(list)
    for r in sorted(turns.repaired(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI"
    assert {c: hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() for c in told} == {c: r["repaired_sha256"] for c, r in told.items()}


def test_one_shuffle(spark):
    plan = turns.repair(turns.damage(spark.createDataFrame(talks(3, 5, 5), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_viterbi_turns(spark, sf)) == expected(rows)
