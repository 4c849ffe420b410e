"""Dataset bundles, evidence subgraphs and context text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bundles(datasets: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """``datasets(id, title, ...)`` with each relation's entities as one sorted string, empty without any.

    All relations go through one shuffle as (dataset, relation, entity); a dataset's links are one list, which is split by relation
    behind it, so relations don't multiply. Only links of ``datasets`` count.
    """
    every = reduce(DataFrame.unionByName, [e.select("dataset_id", F.lit(k).cast("byte").alias("_kind"), F.col("entity_id").cast("string").alias("entity_id")) for k, e in enumerate(relations.values())])
    linked = F.collect_list(F.when(F.col("entity_id").isNotNull(), F.struct("_kind", "entity_id"))).alias("_links")
    got = every.repartition("dataset_id").groupBy(F.col("dataset_id").alias("id")).agg(linked)
    of = lambda k: F.transform(F.filter("_links", lambda x: x["_kind"] == k), lambda x: x["entity_id"])
    got = got.select("id", *[F.array_join(F.array_sort(F.array_distinct(of(k))), ",").alias(name) for k, name in enumerate(relations)])
    return datasets.select("id", "title").join(got, "id", "left").select("id", "title", *[F.coalesce(n, F.lit("")).alias(n) for n in relations])


def without_vectors(rows: DataFrame, name: str = "embedding") -> DataFrame:
    """``rows`` without the vector, at the top and one level deep in structs and maps of properties."""
    out = rows.drop(name)
    for f in out.schema.fields:
        if f.dataType.typeName() == "struct" and name in f.dataType.names:
            out = out.withColumn(f.name, F.col(f.name).dropFields(name))
        elif f.dataType.typeName() == "map" and f.dataType.keyType.typeName() == "string":
            out = out.withColumn(f.name, F.map_filter(f.name, lambda k, v: k != name))
    return out


def citation(title: Column, sources: Column, times: Column) -> Column:
    """``title. source. begin/end.`` of what is known."""
    known = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit("."))) for c in (title, sources, times)]
    return F.concat_ws(" ", *known)


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def subgraph_edges(ids: DataFrame, links: Sequence[tuple[str, str, DataFrame]], has_resource: DataFrame, has_format: DataFrame) -> DataFrame:
    """Edges of the chosen datasets: to their entities, to their resources and from those to formats.

    Each relation is a set of links, so edges differ without being compared. ``ids`` has each dataset once. Formats that name
    their resource's ``dataset_id`` are found by it; else they are joined to the resources.
    """
    near = lambda df: df.join(ids, "dataset_id", "left_semi")
    edge = lambda df, kind, a, b: df.select(a.alias("src"), F.lit(kind).alias("type"), b.alias("dst"))
    res = near(has_resource)
    parts = [edge(near(df), kind, node("Dataset", F.col("dataset_id")), node(label, F.col("entity_id"))) for kind, label, df in links]
    parts.append(edge(res, "HAS_RESOURCE", node("Dataset", F.col("dataset_id")), node("Resource", F.col("resource_id"))))
    hop = near(has_format) if "dataset_id" in has_format.columns else has_format.join(res.select("resource_id").distinct(), "resource_id", "left_semi")
    parts.append(edge(hop, "HAS_FORMAT", node("Resource", F.col("resource_id")), node("Format", F.col("entity_id"))))
    return reduce(DataFrame.unionByName, parts).select(F.sha1(F.concat_ws("|", "src", "type", "dst")).alias("edge_id"), "src", "type", "dst")


def subgraph_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return ends.select("node", F.substring_index("node", ":", 1).alias("label"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges within one hop of the kept ``node``s and, from their resources, to formats."""
    first = edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi")
    res = first.where("type = 'HAS_RESOURCE'").select(F.col("dst").alias("src")).distinct()
    return first.unionByName(edges.where("type = 'HAS_FORMAT'").join(res, "src", "left_semi")).distinct()


def context(ranked: DataFrame) -> DataFrame:
    """``rank. title | description`` lines of a ranked list (at most 20 rows) as one text."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" | "), F.coalesce("notes", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.where("rank <= 20").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))
