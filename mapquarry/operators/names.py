"""Pairs of names that Jaro-Winkler finds alike, without comparing all pairs.

A score of at least ``t`` needs a Jaro similarity J with J + 0.4 (1 - J) >= t, as at most four front letters weigh a tenth
each. J is a third of m/|a| + m/|b| + (m - swaps)/m, so m/|a| + m/|b| >= 3 J - 1, and m letters match only if the names
share m letters. For lengths x and y they so share at least ``shared(x, y)`` of their (letter, occurrence) tokens, and therefore
one of the x - shared + 1 rarest of a and the y - shared + 1 rarest of b. Names meet at those tokens, by pairs of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import jaro_winkler, letters
from .tables import drop, materialise, on_workers


def least_matches(least: float) -> float:
    """m/|a| + m/|b| that a score of ``least`` needs."""
    jaro = (least - 0.4) / 0.6
    return 3 * jaro - 1


def shared(x: Column, y: Column, least: float) -> Column:
    """Letters that names of these lengths share at the score ``least``."""
    return F.ceil(F.lit(least_matches(least)) * x * y / (x + y) - 1e-9)


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``left(a)`` and ``right(b)`` -> pairs ``(a, b)`` with enough letters in common to score ``least``, each once.

    Only letters are compared, so some pairs score less; none that scores ``least`` is missing. Null and blank names
    pair with nothing.
    """
    if least_matches(least) <= 0:
        raise ValueError("the least score must exceed 0.6, below which names need no letter in common")

    def plain(rows: DataFrame, side: str) -> DataFrame:
        named = rows.select(F.col(side).alias("name")).where(F.trim(F.coalesce(F.col(side), F.lit(""))) != "").distinct()
        return named.withColumn("tokens", letters(F.col("name"))).withColumn("n", F.size("tokens"))

    one, two = materialise(plain(left, "a")), materialise(plain(right, "b"))
    held = one.select(F.explode("tokens").alias("token")).unionByName(two.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("held"))
    # a name's length is at most its longest name's, so these tables are short
    lengths = {side: rows.groupBy("n").agg(F.count("*").alias("names")).select(F.col("n").alias("other")) for side, rows in (("a", two), ("b", one))}

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        spread = rows.select("name", "n", F.explode("tokens").alias("token")).join(held, "token")
        place = F.row_number().over(Window.partitionBy("name").orderBy("held", "token"))
        ranked = spread.withColumn("place", place)
        both = ranked.join(F.broadcast(lengths[side]))
        need = shared(F.col("n"), F.col("other"), least)
        met = both.where((need <= F.least("n", "other")) & (F.col("place") <= F.col("n") - need + 1))
        mine, theirs = ("n", "other") if side == "a" else ("other", "n")
        return met.select("token", F.col(mine).alias("x"), F.col(theirs).alias("y"), F.col("name").alias(side))

    met = keyed(one, "a").join(keyed(two, "b"), ["token", "x", "y"]).select("a", "b", "x", "y").distinct()
    known = lambda rows, side: rows.select(F.col("name").alias(side), F.col("tokens").alias(f"tokens_{side}"))
    both = met.join(known(one, "a"), "a").join(known(two, "b"), "b")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= shared(F.col("x"), F.col("y"), least)).select("a", "b")


def alike(left: DataFrame, right: DataFrame, least: float = 0.9, within: bool = False) -> DataFrame:
    """Pairs ``(a, b, score)`` of names with a Jaro-Winkler score, to six digits, of at least ``least``; ``within`` one table those with a < b."""
    on_workers(left.sparkSession)
    found = candidates(left, right, least - 1e-6)
    pairs = materialise(found.where("a < b") if within else found)
    scored = materialise(pairs.select("a", "b", F.round(jaro_winkler(F.col("a"), F.col("b")), 6).alias("score")).where(F.col("score") >= least))
    drop(pairs)
    return scored
