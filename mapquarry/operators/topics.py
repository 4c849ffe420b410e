"""Topic vocabulary: frequencies, seeds, resolution, groups of similar topics, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.similarity import jaro_winkler, token_jaccard
from .components import components
from .merges import followed
from .tables import active

#: Gate to the decision provider: frequency, Jaro-Winkler and token Jaccard of the best hit.
GATE = (5, 0.90, 0.60)
#: Topics of a group shown at once.
CHUNK = 24


def frequencies(pending: DataFrame, topics: DataFrame) -> DataFrame:
    """Datasets of each canonical name, 0 when none."""
    n = pending.groupBy("canonical").agg(F.countDistinct("dataset_id").alias("freq"))
    return topics.join(n, "canonical", "left").select("canonical", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def seeds(freq: DataFrame, k: int = 2000) -> DataFrame:
    return freq.orderBy(F.desc("freq"), F.asc("canonical")).limit(k)


def similar(names: DataFrame, topics: DataFrame, least: float = GATE[2]) -> DataFrame:
    """``names(canonical)`` and ``topics(topic)`` whose token sets reach the Jaccard similarity: canonical, topic, jaccard.

    Sets that similar share one of the ``n - ceil(least * n) + 1`` rarest tokens of each, so only those
    are joined: a token that many names hold is nobody's rare one.
    """
    words = lambda df, c: df.select(F.col(c).alias("name"), F.array_distinct(F.split(c, " ")).alias("tokens")).distinct()
    left, right = words(names, "canonical"), words(topics, "topic")
    held = left.select(F.explode("tokens").alias("token")).unionByName(right.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("held"))

    def rare(rows: DataFrame, name: str) -> DataFrame:
        spread = rows.select("name", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(held, "token")
        place = F.row_number().over(Window.partitionBy("name").orderBy("held", "token"))
        return spread.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("token", F.col("name").alias(name))

    pairs = rare(left, "canonical").join(rare(right, "topic"), "token").select("canonical", "topic").distinct()
    return pairs.withColumn("jaccard", token_jaccard(F.col("canonical"), F.col("topic"))).where(F.col("jaccard") >= least)


def resolve(freq: DataFrame, topics: DataFrame) -> DataFrame:
    """Pending names against active topics: ``existing`` on equal canonical names, else gated.

    The best hit of a name is the topic that shares most tokens with it (ties: smallest name);
    a name that passes all gates is up for ``decide``, others ``create`` a topic. Topics with a
    ``status`` count only if it is ACTIVE or missing.
    """
    known = (active(topics) if "status" in topics.columns else topics).select(F.col("canonical").alias("topic"))
    exact = freq.join(known, F.col("canonical") == F.col("topic"), "left")
    open_ = exact.where("topic is null").select("canonical", "freq")
    scored = similar(open_.where(F.col("freq") >= GATE[0]), known)
    best = scored.groupBy("canonical").agg(F.min_by("topic", F.struct(-F.col("jaccard"), "topic")).alias("topic"))
    judged = open_.join(best, "canonical", "left")
    passed = F.coalesce(jaro_winkler(F.col("canonical"), F.col("topic")) >= GATE[1], F.lit(False))
    return exact.where("topic is not null").select("canonical", "freq", "topic", F.lit("existing").alias("action")).unionByName(
        judged.select("canonical", "freq", F.when(passed, F.col("topic")).alias("topic"), F.when(passed, "decide").otherwise("create").alias("action"))
    )


def resolutions(resolved: DataFrame) -> DataFrame:
    """RESOLVES_TO: each pending name's topic; a name that creates one is a topic of its own."""
    return resolved.select("canonical", F.coalesce("topic", "canonical").alias("topic"))


def materialised(pending: DataFrame, resolved: DataFrame) -> DataFrame:
    """HAS_TOPIC edges of ``pending(dataset_id, canonical)`` by their resolutions, as a set."""
    return pending.join(resolutions(resolved), "canonical").select("dataset_id", F.col("topic").alias("topic_id")).distinct()


def renamed(topics: DataFrame, names: DataFrame) -> DataFrame:
    """``topics(id, canonical, ...)`` with the canonical names of ``names(id, canonical)`` where those are free.

    A name that another topic holds, or that two topics ask for, isn't given (of two askers the least id gets it).
    """
    asked = names.groupBy("canonical").agg(F.min("id").alias("id")).join(topics.select("canonical"), "canonical", "left_anti")
    return topics.join(asked.select("id", F.col("canonical").alias("_free")), "id", "left").withColumn("canonical", F.coalesce("_free", "canonical")).select(*topics.columns)


def deprecated(topics: DataFrame, final: DataFrame) -> DataFrame:
    """``topics`` with ``status`` DEPRECATED and ``merged_into`` for the sources of ``final(src, dst)``; others keep their status."""
    marked = topics.join(final.select(F.col("src").alias("id"), F.col("dst").alias("merged_into")), "id", "left")
    old = F.coalesce("status", F.lit("ACTIVE")) if "status" in topics.columns else F.lit("ACTIVE")
    return marked.withColumn("status", F.when(F.col("merged_into").isNotNull(), "DEPRECATED").otherwise(old))


def keys(topics: DataFrame) -> DataFrame:
    """``(id, canonical, name, aliases)`` -> the namespaced keys under which topics are similar."""
    canon, name = X.canonical_topic(F.col("canonical")), X.canonical_topic(F.col("name"))
    base = F.when(canon != "", canon).otherwise(name)
    tag = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(kind + "|"), c))
    all_keys = F.concat(
        F.array(tag("canon", canon), tag("name", name), tag("sig", X.token_signature(canon)), tag("p3", F.substring(base, 1, 3)), tag("p6", F.substring(base, 1, 6))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: tag("alias", X.canonical_topic(a))),
    )
    return topics.select("id", F.explode(F.array_distinct(F.filter(all_keys, lambda k: k.isNotNull()))).alias("key"))


def groups(keyed: DataFrame) -> DataFrame:
    """Connected components of topics that share a key: (id, group, size), group = least id of a component of two or more.

    Every topic of a key is linked with the key's least topic, so no pair of topics is built.
    """
    least = keyed.groupBy("key").agg(F.min("id").alias("least"))
    stars = components(keyed.join(least, "key").select(F.col("id").alias("a"), F.col("least").alias("b")))
    roots = stars.select(F.col("root").alias("id"), F.col("root").alias("group")).distinct()
    labels = stars.select(F.col("node").alias("id"), F.col("root").alias("group")).unionByName(roots)
    return labels.join(labels.groupBy("group").agg(F.count("*").alias("size")), "group").select("id", "group", "size")


def chunks(grouped: DataFrame, name: Column, size: int = CHUNK) -> DataFrame:
    """Groups over ``size`` are cut by six-character prefix into runs of at most ``size``."""
    prefix = F.when(F.col("size") > size, F.substring(name, 1, 6)).otherwise("")
    w = Window.partitionBy("group", "prefix").orderBy("id")
    return grouped.withColumn("prefix", prefix).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def redirects(merges: DataFrame) -> DataFrame:
    """``merges(src, dst)`` without an order -> the target of each source after at most ``HOPS`` hops.

    The first target of a source counts (least one); a source that leads back to itself is skipped. Decisions that were
    taken one after the other go through ``merges.ordered``.
    """
    hop = merges.where("src != dst").groupBy("src").agg(F.min("dst").alias("dst"))
    return followed(hop).where("src != dst")


def apply_merges(edges: DataFrame, final: DataFrame) -> DataFrame:
    """Edges re-pointed at merge targets, as a set."""
    return edges.join(final, edges.entity_id == final.src, "left").select("dataset_id", F.coalesce("dst", "entity_id").alias("entity_id")).distinct()


def merged_aliases(topics: DataFrame, final: DataFrame) -> DataFrame:
    """Aliases of a target: its own, and the names and aliases of all merged into it; trimmed, without blanks, sorted."""
    moved = topics.join(final, topics.id == final.src, "left").select(F.coalesce("dst", "id").alias("id"), F.when(F.col("dst").isNotNull(), F.col("name")).alias("extra"), "aliases")
    every = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("extra"))
    one = moved.select("id", F.explode_outer(every).alias("alias")).withColumn("alias", F.trim("alias"))
    return one.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("alias") != "", F.col("alias")))).alias("aliases"))
