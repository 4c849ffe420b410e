"""Objects of any shape: replies of models and extras of catalogs, read as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import json_slice


def reply(c: Column) -> Column:
    """The object in a reply, whatever stands around it, as a variant; null if there is none or it is broken."""
    return F.try_parse_json(json_slice(c))


def field(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path; null where it is missing or can't be read as ``kind``. Texts of numbers are numbers too."""
    return F.try_variant_get(v, path, kind)


def first(v: Column, paths: list[str], kind: str = "string") -> Column:
    """The value at the first path that has one of this kind."""
    return F.coalesce(*[field(v, p, kind) for p in paths])


def listed(v: Column, path: str) -> Column:
    """A list of texts: of a list its elements, of a text alone that one; objects in it as JSON. Null elements go."""
    many = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.filter(F.coalesce(many, F.array(field(v, path))), lambda x: x.isNotNull())


def entries(v: Column) -> Column:
    """Extras as a map of texts: from a list of (key, value) objects, the last of a repeated key counting, or from an object.

    Values that are objects or lists are JSON; entries without a key or a value go. Anything else is an empty map.
    """
    pairs = F.transform(
        F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, "$.key", "string").alias("key"), F.try_variant_get(x, "$.value", "string").alias("value"))
    )
    whole = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    keys = F.array_distinct(F.transform(whole, lambda p: p["key"]))
    from_list = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(whole, lambda p: p["key"] == k), -1)["value"]))
    from_object = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(from_list, F.map_filter(from_object, lambda k, x: x.isNotNull()), F.expr("map()").cast("map<string,string>"))


def shape(rows: DataFrame, v: Column) -> DataFrame:
    """One row: the schema that all objects share, and how many rows have one."""
    return rows.agg(F.schema_of_variant_agg(v).alias("shape"), F.count(v).alias("objects"))
