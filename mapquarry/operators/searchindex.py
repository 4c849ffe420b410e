"""A persisted inverted index over several fields, whose searches read a part of it.

A document's part for a term, its impact, is the weighted sum of the fields' BM25 parts. Documents are numbered by key and cut into
blocks; a row of the index is a term's postings within one block with their greatest impact. Files are in order of term and
block, so that a term's rows are few row groups. A search first reads the greatest impacts alone: their sum bounds
every document of a block, and postings are read only of blocks whose bound reaches the k-th best score found so far.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import B, K1, VOCABULARY, tokens
from .retrieve import top_per_group
from .tables import materialise

#: Documents of a block, and bytes of a row group of the index.
BLOCK, ROW_GROUP = 128, 1 << 20
#: Terms that are pushed into the scan as a list; more are joined.
PUSHED = 500


def field_parts(rows: DataFrame, fields: dict[str, float]) -> DataFrame:
    """``rows(key, no, <field>...)`` -> (term, key, no, impact); a field is a string or an array of strings, null ones are empty."""
    parts = []
    for name, weight in fields.items():
        text = F.array_join(name, " ") if rows.schema[name].dataType.typeName() == "array" else F.col(name)
        docs = rows.select("key", "no", tokens(text).alias("tokens")).where(F.size("tokens") > 0)
        tf = docs.select("key", "no", F.size("tokens").alias("n"), F.explode("tokens").alias("term")).groupBy("key", "no", "n", "term").agg(F.count("*").alias("tf"))
        whole = docs.agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("mean"))
        known = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").join(F.broadcast(whole))  # one row
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        parts.append(known.select("term", "key", "no", part.alias("impact")))
    return reduce(DataFrame.unionByName, parts).groupBy("term", "key", "no").agg(F.sum("impact").alias("impact"))


def build(rows: DataFrame, key: str, fields: dict[str, float], path: str, block: int = BLOCK) -> SearchIndex:
    """Write the index of ``rows`` (``key`` unique, not null) over weighted ``fields`` to ``path``; rows without a token aren't found.

    A term of a third of all documents is many rows, which the range partitioning splits like any others.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(key).alias("key"), *fields).repartitionByRange("key").sortWithinPartitions("key")
    numbered = materialise(plain.withColumn("no", F.monotonically_increasing_id()))
    postings = field_parts(numbered, fields).groupBy("term", F.expr(f"no div {block}").alias("block")).agg(
        F.max("impact").alias("greatest"), F.sort_array(F.collect_list(F.struct("key", "impact"))).alias("postings")
    )
    files = postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    files.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", 1000).parquet(path)
    return SearchIndex(spark, path)


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str

    def rows(self, terms: DataFrame) -> DataFrame:
        """Rows of ``terms(term)``: a short list skips row groups, a bounded one is broadcast, a longer one is joined."""
        index = self.spark.read.parquet(self.path)
        asked = [r["term"] for r in terms.limit(PUSHED + 1).collect()]
        if len(asked) <= PUSHED:
            return index.where(F.col("term").isin(asked)) if asked else index.limit(0)
        return index.join(F.broadcast(terms) if terms.count() <= VOCABULARY else terms, "term", "left_semi")

    def scores(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """Whole scores of the documents in ``blocks(query_id, block)``."""
        wanted = blocks.join(asked, "query_id")
        found = self.rows(wanted.select("term").distinct()).select("term", "block", "postings").join(wanted, ["term", "block"])
        spread = found.select("query_id", F.explode("postings").alias("p")).select("query_id", "p.key", "p.impact")
        return spread.groupBy("query_id", "key").agg(F.round(F.sum("impact"), 6).alias("score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries(query_id, text)`` -> the ``k`` best documents of each: query_id, key, score, rank; equal scores by key.

        Nothing that could be among the best is skipped. A query without a token, or of unknown ones, finds nothing.
        """
        asked = materialise(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct())
        heads = self.rows(materialise(asked.select("term").distinct())).select("term", "block", "greatest")
        bounds = materialise(heads.join(asked, "term").groupBy("query_id", "block").agg(F.sum("greatest").alias("bound")))
        # k blocks have at least k documents
        first = materialise(top_per_group(bounds, "query_id", k, F.desc("bound"), F.asc("block")).select("query_id", "block"))
        best = top_per_group(self.scores(asked, first), "query_id", k, F.desc("score"), F.asc("key"))
        reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
        # scores are rounded, bounds aren't
        open_ = materialise(bounds.join(reached, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("least") - 1e-5, F.lit(True))).select("query_id", "block"))
        return top_per_group(self.scores(asked, open_), "query_id", k, F.desc("score"), F.asc("key"))
