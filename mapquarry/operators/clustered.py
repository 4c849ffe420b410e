"""Boxes in files along a space-filling curve, so that a box search reads few row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Bits of each of a box's four sides in its curve value, and bytes of a row group.
BITS, ROW_GROUP = 12, 1 << 20
SIDES = ("west", "south", "east", "north")
#: Width of the range of each side.
_RANGE = {"west": (-180.0, 360.0), "east": (-180.0, 360.0), "south": (-90.0, 180.0), "north": (-90.0, 180.0)}


def curve(sides: dict[str, Column], bits: int = BITS) -> Column:
    """Place of a box on the Z-order curve through its four sides: their bits in turn, the greatest first. Null for a box without a side.

    Sides beyond the world count as its edge.
    """
    out = F.lit(0).cast("long")
    for k, name in enumerate(SIDES):
        low, width = _RANGE[name]
        cell = F.floor(F.least(F.greatest((sides[name] - low) / width, F.lit(0.0)), F.lit(1 - 2.0 ** -(bits + 1))) * (1 << bits)).cast("long")
        for b in range(bits):
            out = out + F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), 4 * b + 3 - k)
    return F.when(reduce(lambda a, b: a & b, [sides[name].isNotNull() for name in SIDES]), out)


def write(boxes: DataFrame, path: str, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write ``boxes(west, south, east, north, ...)`` in the order of the curve; boxes without a side come first.

    Range partitioning samples the curve, so that many boxes at one place are a few files and not one; those with one value stay together.
    """
    keyed = boxes.withColumn("_curve", curve({s: F.col(s) for s in SIDES}))
    dealt = keyed.repartitionByRange(files, "_curve") if files else keyed.repartitionByRange("_curve")
    dealt.sortWithinPartitions("_curve").drop("_curve").write.option("parquet.block.size", row_group).option("parquet.page.row.count.limit", 2000).parquet(path)


def overlapping(spark: SparkSession, path: str, box: geo.Box) -> DataFrame:
    """Rows whose boxes overlap; the four comparisons are pushed to row groups and pages, which the curve makes narrow."""
    return spark.read.parquet(path).where(geo.overlaps(*(F.col(s) for s in SIDES), box))
