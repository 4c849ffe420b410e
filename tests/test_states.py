from __future__ import annotations

import random

import pytest

from mapquarry.streaming import states as S

HOUR = 3600 * 1_000_000


def messages(seed, n, convs=6):
    rnd = random.Random(seed)
    at, out = HOUR, []
    for seq in range(n):
        at += rnd.choice([0, HOUR // 4, HOUR, 3 * HOUR])
        kind = rnd.choice(["intent", "intent", "question", "answer", "turn", "turn", "reset", "subscribe", "unsubscribe", "status", "status"])
        out.append((rnd.randrange(convs), at, seq, kind, rnd.choice(["topic", "space"]), rnd.choice(["a", "b", None, f"v{seq}"])))
    return out


def one_by_one(rows, idle):
    state, sent = {}, []
    for conv, at, seq, kind, name, value in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(conv, {"at": None, "question": 0, "intent": {}, "pending": None, "turns": [], "sub": False})
        idle_now = s["at"] is not None and at - s["at"] > idle
        if idle_now or kind == "reset":
            s |= {"intent": {}, "pending": None, "turns": [], "sub": s["sub"] and not idle_now}
        s["question"] += kind == "reset"
        if kind == "intent":
            s["intent"][name] = value
        elif kind == "question":
            s["pending"] = value
        elif kind == "answer":
            s["pending"] = None
        elif kind == "turn":
            s["turns"].append(value)
        elif kind in ("subscribe", "unsubscribe"):
            s["sub"] = kind == "subscribe"
        elif s["sub"] and kind == "status":
            sent.append((conv, at, seq, name, value))
        s |= {"at": at, "seq": seq}
    return sorted((c, s["at"], s["seq"], s["question"], s["pending"], len(s["turns"]), s["turns"][-1] if s["turns"] else None, s["sub"], tuple(sorted(s["intent"]))) for c, s in state.items()), sorted(sent, key=str)


def short(df):
    return sorted((r["conv_id"], r["at"], r["seq"], r["question"], r["pending"], r["turns"], r["last_turn"], r["subscribed"], tuple(x.split("=")[0] for x in r["intent"].split(";") if x)) for r in df.collect())


@pytest.mark.parametrize("idle", [8 * HOUR, 10**15])
def test_batch_plans_equal_one_message_after_the_other(spark, idle):
    rows = messages(1, 400)
    df = spark.createDataFrame(rows, S.MESSAGES).repartition(5)
    want, sent = one_by_one(rows, idle)
    assert len(sent) > 10
    assert short(S.states(df, idle)) == want
    assert sorted(map(tuple, S.statuses(df, idle).collect()), key=str) == sent
    none = df.limit(0)
    assert S.states(none).count() == 0 == S.statuses(none).count()


def test_batches_and_a_restart_equal_the_batch_plan(spark, tmp_path):
    """Four files in batches of one, two of them after a restart from the checkpoint; idle conversations expire by timer."""
    rows, idle = [(99, HOUR, -1, "turn", None, "left alone"), *messages(2, 240)], 8 * HOUR
    parts = [rows[:60], rows[60:120], rows[120:180], rows[180:]]
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def land(part):
        spark.createDataFrame(part, S.MESSAGES).coalesce(1).write.mode("append").parquet(path)

    land(parts[0])
    land(parts[1])
    S.run(spark, path, out, check, idle=idle)
    land(parts[2])
    land(parts[3])
    got = S.run(spark, path, out, check, idle=idle)
    df = spark.createDataFrame(rows, S.MESSAGES)
    assert sorted(map(tuple, S.latest(got).collect()), key=str) == sorted(map(tuple, S.states(df, idle).select(*S.STATE).collect()), key=str)
    assert sorted(map(tuple, S.delivered(got).collect()), key=str) == sorted(map(tuple, S.statuses(df, idle).collect()), key=str)
    assert got.where("row = 'expired'").count() > 0
    again = S.run(spark, path, out, check, idle=idle)
    assert again.count() == got.count()  # nothing new, nothing twice


def test_a_batch_reads_neither_memory_nor_timers():
    """What a conversation has said may be long: its count, last text and timer are in the value that is read anyway."""

    class Held:
        def __init__(self):
            self.value, self.items, self.added, self.timers, self.clear = None, {}, [], [], lambda: None
            self.appendList, self.registerTimer, self.deleteTimer = self.added.extend, self.timers.append, self.timers.remove

        getValueState = getMapState = getListState = lambda self, name, *_: self.__dict__.setdefault(f"_{name}", Held())

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def updateValue(self, key, value):
            self.items[key] = value

        def iterator(self):
            return iter(self.items.items())

    handle, p = Held(), S.Conversations(HOUR)
    p.init(handle)
    p.memory.get = None
    row = lambda at, kind, name, value: S.Row(at=at, seq=at, kind=kind, name=name, value=value)
    list(p.handleInputRows((1,), iter([row(2, "turn", None, "b"), row(1, "turn", None, "a")]), None))
    (last,) = p.handleInputRows((1,), iter([row(3, "intent", "topic", "x"), row(4, "turn", None, "c")]), None)
    assert (last.turns, last.last_turn, last.intent) == (3, "c", "topic=x") and len(handle.timers) == 1 and len(p.memory.added) == 3
