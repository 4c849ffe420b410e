"""Boxes in degrees: validity, overlap, score, centroid and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]  # west, south, east, north


def overlaps(w: Column, s: Column, e: Column, n: Column, box: Box) -> Column:
    """Closed boxes: touching ones overlap. Four comparisons that reach the Parquet scan."""
    return (w <= box[2]) & (e >= box[0]) & (s <= box[3]) & (n >= box[1])


def valid(w: Column, s: Column, e: Column, n: Column, ordered: bool = False) -> Column:
    inside = w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90)
    return F.coalesce(inside & (w <= e) & (s <= n) if ordered else inside, F.lit(False))


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def box_f1(w: Column, s: Column, e: Column, n: Column, box: Box) -> Column:
    """Harmonic mean of the shares of the dataset's and the query's area in common; degrees squared."""
    width = F.least(e, F.lit(box[2])) - F.greatest(w, F.lit(box[0]))
    height = F.least(n, F.lit(box[3])) - F.greatest(s, F.lit(box[1]))
    own, asked = (e - w) * (n - s), F.lit(float((box[2] - box[0]) * (box[3] - box[1])))
    some = (width > 0) & (height > 0) & (own > 0) & (asked > 0)
    return F.coalesce(F.when(some, F.least(F.lit(1.0), 2.0 * width * height / (own + asked))), F.lit(0.0))


def centroid(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(((w + e) / 2).alias("lon"), ((s + n) / 2).alias("lat"))


def wkt(w: Column, s: Column, e: Column, n: Column, comma: str = ", ") -> Column:
    corners = [F.concat_ws(" ", x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(comma, *corners), F.lit("))"))


def parse_box(text: Column) -> Column:
    """``[bbox=]a,b,c,d`` -> struct(west, south, east, north) with each axis in order, else null."""
    number = "(-?[0-9]+(?:\\.[0-9]+)?)"
    pattern = f"(?i)(?:bbox\\s*=\\s*)?{number}\\s*,\\s*{number}\\s*,\\s*{number}\\s*,\\s*{number}"
    v = [F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2, 3, 4)]
    lon, lat = ordered(v[0], v[2]), ordered(v[1], v[3])
    return F.when(
        v[3].isNotNull(), F.struct(lon[0].alias("west"), lat[0].alias("south"), lon[1].alias("east"), lat[1].alias("north"))
    )
