"""Full-text search of many queries at once, by classes of like rows.

Scores are those of ``searchindex``. An index opens few blocks for a rare word; many queries of common words would open
all of them for each. Here rows that hold the same asked words in fields of the same lengths are one class with its first keys, and
queries of the same words are one query. Blocks of queries meet shares of the classes; a task adds the parts of a share's
classes as arrays and keeps the k best of each query. Nothing is cut: a class behind k others can't have a row among the k best.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import B, K1, VOCABULARY, tokens
from .retrieve import SELECTION, best_of_row, rounded, top_per_group
from .tables import materialise, on_workers

#: Classes of one share, words that are filtered within a row, and numbers that a task keeps of its words' parts.
SHARE, PUSHED, CACHED = 8192, 500, 8_000_000


def _marked(words: Column, mark: str) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(mark), t))


def classes(rows: DataFrame, key: str, fields: dict[str, float], vocabulary: DataFrame, k: int) -> DataFrame:
    """(cid, count, keys, like): rows of the same lengths and asked words; ``cid`` is the first of ``keys``, the ``k`` first ones."""
    words, sizes = [], []
    for f, name in enumerate(fields):
        text = F.array_join(name, " ") if rows.schema[name].dataType.typeName() == "array" else F.col(name)
        word = tokens(F.coalesce(text, F.lit("")))
        words.append(_marked(word, f"{f}:"))
        sizes.append(F.size(word).cast("string"))
    asked = [r["term"] for r in vocabulary.limit(PUSHED + 1).collect()]
    docs = rows.select(F.col(key).alias("key"), F.concat_ws(" ", *sizes).alias("sizes"), F.concat(*words).alias("words"))
    if len(asked) <= PUSHED:
        here = [f"{f}:{t}" for f in range(len(fields)) for t in asked]
        docs = docs.withColumn("words", F.filter("words", lambda t: t.isin(here)) if here else F.array().cast("array<string>"))
    else:
        terms = F.broadcast(vocabulary) if vocabulary.count() <= VOCABULARY else vocabulary
        held = docs.select("key", F.explode("words").alias("word")).withColumn("term", F.substring_index("word", ":", -1)).join(terms, "term", "left_semi")
        docs = docs.drop("words").join(held.groupBy("key").agg(F.collect_list("word").alias("words")), "key", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    like = docs.select("key", F.concat_ws(" ", "sizes", F.array_join(F.array_sort("words"), " ")).alias("like"))
    # a large class is gathered in parts
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    first = lambda c: F.slice(F.sort_array(c), 1, k).alias("keys")
    some = like.groupBy("like", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).agg(F.count("*").alias("count"), first(F.collect_list("key")))
    return some.groupBy("like").agg(F.sum("count").alias("count"), first(F.flatten(F.collect_list("keys")))).select(F.col("keys")[0].alias("cid"), "count", "keys", "like")


def impacts(found: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(cid, term, impact) for each field in which a class holds a term."""
    sizes = F.transform(F.slice(F.split("like", " "), 1, len(fields)), lambda s: s.cast("long"))
    whole = found.select("count", F.posexplode(sizes).alias("field", "n")).where("n > 0").groupBy("field").agg(
        F.sum("count").alias("docs"), (F.sum(F.col("n") * F.col("count")) / F.sum("count")).alias("mean")
    )
    words = F.filter(F.slice(F.split("like", " "), len(fields) + 1, F.size(F.split("like", " "))), lambda w: w != "")
    held = found.withColumn("sizes", sizes).withColumn("words", words).select("cid", "count", "sizes", "words", F.explode(F.array_distinct("words")).alias("word"))
    tf = held.select(
        "cid", "count", F.substring_index("word", ":", 1).cast("int").alias("field"), F.substring_index("word", ":", -1).alias("term"), "sizes",
        F.size(F.filter("words", lambda w: w == F.col("word"))).alias("tf"),
    ).withColumn("n", F.get("sizes", "field"))
    known = tf.groupBy("field", "term").agg(F.sum("count").alias("df")).join(F.broadcast(whole), "field")  # one row a field
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in fields.values()]), F.col("field") + 1)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return tf.join(known, ["field", "term"]).select("cid", "term", part.alias("impact"))


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(asked: pa.Table, parts: pa.Table) -> pa.Table:
        if not asked.num_rows or not parts.num_rows:
            return pa.table({"text": asked["text"].slice(0, 0), "cid": parts["cid"].slice(0, 0), "score": pa.array([], pa.float64())})
        parts = parts.sort_by([("cid", "ascending")])
        cids = parts["cid"].combine_chunks().unique()  # in order
        at = pc.index_in(parts["cid"], cids).combine_chunks().to_numpy(zero_copy_only=False)
        word = parts["term"].combine_chunks().dictionary_encode()
        code, impact = word.indices.to_numpy(), parts["impact"].combine_chunks().to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(word.dictionary) + 1))
        place = {t: i for i, t in enumerate(word.dictionary.to_pylist())}

        @lru_cache(maxsize=max(1, CACHED // len(cids)))
        def of(i: int) -> np.ndarray:
            rows = order[cuts[i] : cuts[i + 1]]
            return np.bincount(at[rows], impact[rows], len(cids))

        texts, where, scores = [], [], []
        for j, text in enumerate(asked["text"].to_pylist()):
            known = [place[t] for t in text.split(" ") if t in place]
            if not known:
                continue
            total = np.zeros(len(cids))
            for i in known:
                total += of(i)
            score = np.where(total > 0, rounded(total), -np.inf)
            kept = best_of_row(score, k)
            kept = kept[score[kept] >= 0]
            texts.append(np.full(len(kept), j))
            where.append(kept)
            scores.append(score[kept])
        whole = lambda a, kind: np.concatenate(a).astype(kind) if a else np.array([], kind)
        return pa.table({"text": asked["text"].take(pa.array(whole(texts, "int64"))), "cid": cids.take(pa.array(whole(where, "int64"))), "score": whole(scores, "float64")})

    return best


def search(rows: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, k: int, share: int = SHARE, most: int = SELECTION) -> DataFrame:
    """``queries(query_id, text)`` -> the ``k`` best rows of each over weighted ``fields``: query_id, key, score, rank; equal scores by key.

    ``key`` is unique and not null. A query without a token, or of unknown ones, finds nothing.
    """
    on_workers(rows.sparkSession)
    terms = F.array_sort(F.array_distinct(tokens(F.col("text"))))
    asked = materialise(queries.select("query_id", F.array_join(terms, " ").alias("text")).where("text != ''"))
    texts = materialise(asked.select("text").distinct())
    vocabulary = texts.select(F.explode(F.split("text", " ")).alias("term")).distinct()
    found = materialise(classes(rows, key, fields, vocabulary, k))
    blocks, shares = -(-texts.count() // most), max(1, -(-found.count() // share))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    left = texts.select("text", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1))).alias("block"), upto(shares).alias("share"))
    right = impacts(found, fields).withColumn("share", F.pmod(F.xxhash64("cid"), F.lit(shares))).withColumn("block", upto(blocks))
    out = f"text string, cid {rows.schema[key].dataType.simpleString()}, score double"
    pairs = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(_best(k), out)
    best = top_per_group(pairs, "text", k, F.desc("score"), F.asc("cid")).drop("rank")
    each = best.join(found.select("cid", "keys"), "cid").select("text", "score", F.explode("keys").alias("key"))
    return asked.join(top_per_group(each, "text", k, F.desc("score"), F.asc("key")), "text").select("query_id", "key", "score", "rank")
