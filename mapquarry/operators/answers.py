"""Answers to a clarifying question, read by a small grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free

#: A pick is a number of up to three digits; a dimension and its value in one line.
PICK = "\\b(\\d{1,3})\\b"
PAIR = "(?i)\\b(topic|space|format|license|organization|source)\\s*=\\s*(.+)$"


def said(answer: Column) -> Column:
    """The answer without blanks around it; of one that begins like a click in the list only its first number."""
    plain = F.trim(F.coalesce(answer, F.lit("")))
    clicked = F.lower(plain).startswith("hitl selection") & plain.rlike(PICK)
    return F.when(clicked, F.regexp_extract(plain, PICK, 1)).otherwise(plain)


def resolved(asked: DataFrame) -> DataFrame:
    """``asked`` with ``ids``, ``value``, ``needs_clarification`` and ``new_confidence``.

    ``asked`` has ``answer``, ``candidates`` (an array of (id, name)) and ``confidence``. In this order: ``continue`` or
    nothing takes all candidates (0.8); numbers take the candidates at those places, each once, in the order said (1.0); the first
    candidate of that name, else the first whose name holds the answer or is held by it (1.0); ``dimension = value`` takes the
    value without a candidate (at least 0.95); anything else is kept as the value and asked for again. Without candidates
    (null or empty) only the last two apply.
    """
    said_, known_, picked, named, chosen_ = (free(n, asked) for n in ("_said", "_known", "_picked", "_named", "_chosen"))
    rows = asked.withColumns({said_: said(F.col("answer")), known_: F.coalesce("candidates", F.expr("array()").cast(asked.schema["candidates"].dataType))})
    known, low = F.col(known_), F.lower(said_)
    every = (F.size(known) > 0) & low.isin("", "continue")
    numbers = F.transform(F.regexp_extract_all(said_, F.lit(PICK), F.lit(1)), lambda x: x.cast("int"))
    picks = F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.size(known))))
    name = lambda c: F.lower(c["name"])
    same = F.filter(known, lambda c: F.coalesce(name(c) == low, F.lit(False)))
    near = F.filter(known, lambda c: F.coalesce(name(c).contains(low) | low.contains(name(c)), F.lit(False)))
    rows = rows.withColumns({picked: F.transform(picks, lambda k: F.element_at(known, k)), named: F.slice(F.when(F.size(same) > 0, same).otherwise(near), 1, 1)})
    rows = rows.withColumn(chosen_, F.when(every, known).when(F.size(picked) > 0, F.col(picked)).otherwise(F.col(named)))
    found = F.size(chosen_) > 0
    pair = F.regexp_extract(F.trim(F.coalesce("answer", F.lit(""))), PAIR, 2)
    told = pair != ""
    return rows.select(
        *asked.columns,
        F.when(found, F.filter(F.transform(chosen_, lambda c: c["id"]), lambda x: x.isNotNull())).alias("ids"),
        F.when(found, F.element_at(chosen_, 1)["name"]).when(told, F.trim(pair)).otherwise(F.col(said_)).alias("value"),
        (~found & ~told).alias("needs_clarification"),
        F.when(every, 0.8).when(found, 1.0).when(told, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.95))).otherwise(F.col("confidence")).alias("new_confidence"),
    )
