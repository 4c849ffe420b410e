"""Merge decisions taken in their order, on many machines.

Decisions arrive one after the other: both ends are followed through the redirects so far, equal ends are skipped, else
the first end's topic is merged into the second's. Only decisions of one connected group can meet, and within a
group time is halved: the later half of a crowded block needs no more of the earlier half than which topics it
connected. So blocks of bounded size are replayed side by side with names for the topics that lead a group when the block begins,
and the names are resolved afterwards by pointer jumping over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .tables import drop, materialise, on_workers

#: Least confidence of a decision that is carried out, redirects that are followed from one topic.
CONFIDENCE, HOPS = 0.85, 20
#: Decisions that one task replays in memory.
BLOCK = 200_000

_SCHEMA = "kind string, part string, block string, seq long, one string, two string"
_NAMES = ["kind", "part", "block", "seq", "one", "two"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    kinds = [pa.int64() if n == "seq" else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, block, seq, a, b)`` by block and seq -> decisions ``merged``/``same`` and each group's ``end``.

    Within a block a topic name stands for whichever topic leads its group when the block begins; ``one`` is merged into
    ``two``. An end names the least topic of a group (``one``) and the name that leads it (``two``).
    """
    at: tuple[str, str] | None = None
    up: dict[str, str] = {}
    leads: dict[str, str] = {}
    least: dict[str, str] = {}
    out: list[tuple] = []

    def find(x: str) -> str:
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def close() -> None:
        if at is not None:
            out.extend(("end", *at, None, least.get(x, x), leads.get(x, x)) for x in {find(x) for x in list(up)})
        up.clear()
        leads.clear()
        least.clear()

    for batch in batches:
        for part, block, seq, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, block) != at:
                close()
                at = (part, block)
            x, y = find(a), find(b)
            if x == y:
                out.append(("same", part, block, seq, None, None))
                continue
            source, target = leads.get(x, x), leads.get(y, y)
            up[x] = y
            leads[y], least[y] = target, min(least.get(x, x), least.get(y, y))
            out.append(("merged", part, block, seq, source, target))
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
    close()
    yield _batch(out)


def _guarded(hops: int):
    """Sequential replay of whole groups that lets at most ``hops`` redirects be followed; holds one place a topic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        redirect: dict[str, str] = {}
        holds: dict[str, list[str]] = {}
        out: list[tuple] = []

        def resolve(x: str) -> str:
            for _ in range(hops):
                if x not in redirect:
                    break
                x = redirect[x]
            return x

        def close() -> None:
            out.extend(("place", at, None, None, topic, where) for where, topics in holds.items() for topic in topics)
            redirect.clear()
            holds.clear()

        for batch in batches:
            for part, _, seq, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    close()
                    at = part
                for x in (a, b):
                    if x not in holds and x not in redirect:
                        holds[x] = [x]
                x, y = resolve(a), resolve(b)
                if x == y:
                    out.append(("same", part, None, seq, None, None))
                    continue
                small, large = sorted((holds.pop(x, []), holds.pop(y, [])), key=len)
                large.extend(small)
                holds[y] = large
                redirect[x] = y
                out.append(("merged", part, None, seq, x, y))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out.clear()
        close()
        yield _batch(out)

    return run


def _named(c: str) -> Column:
    return F.concat("block", F.lit("\x1f"), F.col(c))


def halved(work: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``(part, block, seq, a, b)`` in blocks of at most ``most`` rows, ends named by what earlier blocks connected; and the rows whose ends were one."""
    same = None
    while True:
        n = work.groupBy("block").agg(F.count("*").alias("n"), F.percentile_approx("seq", 0.5, 10_000).alias("cut"), F.max("seq").alias("last"))
        crowded = materialise(n.where(F.col("n") > most).select("block", F.least("cut", F.col("last") - 1).alias("cut")))
        if crowded.isEmpty():
            return work, same
        split = work.join(crowded, "block", "left")
        early = split.where(F.col("seq") <= F.col("cut"))
        stars = components(early.select(_named("a").alias("a"), _named("b").alias("b")))
        late = split.where(F.col("seq") > F.col("cut")).withColumns({"ka": _named("a"), "kb": _named("b")})
        for end in ("a", "b"):
            least = stars.select(F.col("node").alias(f"k{end}"), F.element_at(F.split("root", "\x1f"), -1).alias(f"to_{end}"))
            late = late.join(least, f"k{end}", "left").withColumn(end, F.coalesce(f"to_{end}", end))
        columns = ["part", "block", "seq", "a", "b"]
        late = late.select("part", F.concat("block", F.lit("1")).alias("block"), "seq", "a", "b")
        rest = split.where("cut is null").select(*columns).unionByName(early.select("part", F.concat("block", F.lit("0")).alias("block"), "seq", "a", "b"))
        found = late.where("a = b").select("part", "seq")
        same = materialise(found if same is None else same.unionByName(found))
        work = materialise(rest.unionByName(late.where("a != b")))
        drop(crowded)


def _resolved(told: DataFrame) -> DataFrame:
    """Merged decisions ``(part, seq, source, target)`` with the names of blocks replaced by topics."""
    ends = told.where("kind = 'end'").select("part", "block", F.col("one").alias("name"), F.col("two").alias("led_by"))
    steps = told.where("kind = 'merged'")
    if steps.select("block").distinct().count() == steps.select("part").distinct().count():
        return steps.select("part", "seq", F.col("one").alias("source"), F.col("two").alias("target"))
    key = F.concat_ws("\x1e", "part", "block", "name")
    none = F.lit(None).cast("string")

    def before(asked: DataFrame) -> DataFrame:
        """``asked(part, block, name, ...)`` with ``last``: the key of the name's group after the last block before."""
        others = [c for c in asked.columns if c not in ("part", "block", "name")]
        both = asked.withColumns({"end": none, "first": F.lit(0)}).unionByName(ends.select("part", "block", "name", *[none.alias(c) if asked.schema[c].dataType.simpleString() == "string" else F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in others], key.alias("end"), F.lit(1).alias("first")))
        w = Window.partitionBy("part", "name").orderBy("block", "first").rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn("last", F.last("end", ignorenulls=True).over(w)).where("first = 0").drop("first", "end")

    pointers = before(ends.select("part", "block", F.col("led_by").alias("name"), key.alias("key")))
    at = materialise(pointers.select("key", F.col("name").alias("topic"), "last"))
    while not at.where("last is not null").isEmpty():
        nxt = at.select(F.col("key").alias("last"), F.col("topic").alias("_topic"), F.col("last").alias("_last"))
        old, at = at, materialise(at.join(nxt, "last", "left").select("key", F.coalesce("_topic", "topic").alias("topic"), F.col("_last").alias("last")))
        drop(old)
    out = steps.select("part", "block", "seq", "one", "two")
    for side, name in (("one", "source"), ("two", "target")):
        asked = before(out.withColumnRenamed(side, "name"))
        known = at.select(F.col("key").alias("last"), "topic")
        out = asked.join(known, "last", "left").withColumn(name, F.coalesce("topic", "name")).drop("last", "topic", "name")
    return out.select("part", "seq", "source", "target")


def followed(hop: DataFrame, hops: int = HOPS) -> DataFrame:
    """Redirects ``(src, dst)``, one a source, followed exactly ``hops`` times or to their end."""

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        nxt = second.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        return materialise(first.join(nxt, "dst", "left").select("src", F.coalesce("_next", "dst").alias("dst")))

    power, out = hop, None
    while hops:
        if hops & 1:
            out = power if out is None else then(out, power)
        hops >>= 1
        power = then(power, power) if hops else power
    return out


def ordered(decisions: DataFrame, least: float = CONFIDENCE, hops: int = HOPS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``decisions(seq, src, dst, confidence)`` in order of ``seq``, a key -> what became of each, and where topics end.

    The first table has seq, outcome (``merged``, ``same``, ``missing`` for a null or blank end, ``low`` for a confidence
    below ``least`` or none) and the topics source and target that a merge took place between; the second has src and dst of all
    topics that ended elsewhere. Groups in which more than ``hops`` redirects stand in a row are replayed one decision after
    the other by one task each, which holds one place a topic. An empty table gives two.
    """
    on_workers(decisions.sparkSession)
    rows = decisions.select(F.col("seq").cast("long"), F.col("src").cast("string"), F.col("dst").cast("string"), "confidence")
    blank = (F.trim(F.coalesce("src", F.lit(""))) == "") | (F.trim(F.coalesce("dst", F.lit(""))) == "")
    early = F.when(F.coalesce(F.col("confidence") < least, F.lit(True)), "low").when(blank, "missing").when(F.col("src") == F.col("dst"), "same")
    judged = materialise(rows.withColumn("outcome", early))
    edges = judged.where("outcome is null").select("seq", F.col("src").alias("a"), F.col("dst").alias("b"))
    stars = components(edges.select("a", "b"))
    grouped = edges.join(stars, edges.a == stars.node, "left").select(F.coalesce("root", "a").alias("part"), "seq", "a", "b")
    first = materialise(grouped.select("part", F.concat("part", F.lit("\x1f")).alias("block"), "seq", "a", "b"))
    work, same = halved(first, block)
    told = materialise(work.repartition("block").sortWithinPartitions("block", "seq").mapInArrow(_replay, _SCHEMA))
    merged = materialise(_resolved(told))
    hop = merged.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    final = followed(hop, hops)
    deep = materialise(final.join(hop.select(F.col("src").alias("dst")), "dst", "left_semi").join(merged.select(F.col("source").alias("src"), "part"), "src").select("part").distinct())
    merged = merged.join(deep, "part", "left_anti").select("seq", F.lit("merged").alias("outcome"), "source", "target")
    none = F.lit(None).cast("string")
    plain = told.where("kind = 'same'").select("part", "seq")
    plain = (plain.unionByName(same) if same is not None else plain).join(deep, "part", "left_anti")
    ends = final.where("src != dst").select("src", "dst")
    again = None
    if not deep.isEmpty():
        slow = first.join(deep, "part", "left_semi").repartition("part").sortWithinPartitions("part", "seq")
        again = materialise(slow.mapInArrow(_guarded(hops), _SCHEMA))
        moved = again.where("kind = 'place' and one != two").select(F.col("one").alias("src"), F.col("two").alias("dst"))
        members = first.join(deep, "part", "left_semi").select(F.explode(F.array("a", "b")).alias("src")).distinct()
        ends = ends.join(members, "src", "left_anti").unionByName(moved)
    out = (
        judged.where("outcome is not null").select("seq", "outcome", none.alias("source"), none.alias("target"))
        .unionByName(plain.select("seq", F.lit("same").alias("outcome"), none.alias("source"), none.alias("target"))).unionByName(merged)
    )
    if again is not None:
        out = out.unionByName(again.where("kind in ('same', 'merged')").select("seq", F.col("kind").alias("outcome"), F.col("one").alias("source"), F.col("two").alias("target")))
    return out, ends
