"""A corpus pipeline of five operators: documents in, packed sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapquarry.llm import exactdup, langid, mixing, packing, shingles
from mapquarry.llm.queries import TOKENIZER, residue
from mapquarry.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those whose language the codewords can't tell; others stay whole.

    So null and empty texts go. Null ids and repeated rows are judged by their text; columns other than
    those of documents are dropped; an empty table stays empty.
    """
    model = langid.train(docs, residue(4) != 2)
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("lang_ambiguous")).select(*COLUMNS)


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a ``row_key`` that differs between all rows, whatever their ids: file and place in the file.

    A table that isn't a plain scan of Parquet files is written first, so that a key always means the same row.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = scratch.write(docs)
    try:
        at = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        at = scratch.write(docs).select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    names = sorted(r[0] for r in at.select("_file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(n, i << 40) for i, n in enumerate(names)], "_file string, _first long")
    return at.join(F.broadcast(files), "_file").select(*COLUMNS, (F.col("_first") + F.col("_row")).alias("row_key"))


def least(rows: DataFrame, group: str, *first: Column) -> DataFrame:
    """The ``key`` of each group's row that stays: by ``first``, then the smallest doc_id (null last), then the first row."""
    order = F.struct(*first, F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    return rows.groupBy(group).agg(F.min(order)["key"].alias("key"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return rows.join(shingles.small(dropped), F.col("row_key") == F.col("key"), "left_anti").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, of these the least doc_id, null last.

    Rows with a null doc_id are documents like others. Of rows that share a doc_id each is judged by
    itself: equal ones leave one row, and a dropped row doesn't stay because another of its id does.
    """
    scratch = Scratch(spark, "exact_rows")
    rows = keyed(docs, scratch)
    judged = exactdup.exact_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"))
    groups = scratch.write(judged.where("group_size > 1").select(F.col("doc_id").alias("key"), F.col("keep_id").alias("root")))
    known = rows.select(F.col("row_key").alias("key"), "doc_id", F.length("text").alias("size")).join(shingles.small(groups), "key")
    best = least(known, "root", -F.coalesce("size", F.lit(0)))
    return without(rows, scratch.write(groups.select("key").join(best, "key", "left_anti")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard similarities of 0.8 or more the row with the least doc_id stays, null last.

    Operator 3's fingerprints, over five words, name candidates; its radius can't reach all of them at
    this similarity, so bands of minima name the rest, and whole shingle sets decide. Null and repeated
    ids count as in ``exact``; null and blank texts are copies of each other; an empty table stays empty.
    """
    scratch = Scratch(spark, "near")
    rows = keyed(docs, scratch)
    groups = shingles.near_components(rows.select(F.col("row_key").alias("key"), "text"), scratch)
    known = rows.select(F.col("row_key").alias("key"), "doc_id").join(shingles.small(groups), "key")
    return without(rows, scratch.write(groups.select("key").join(least(known, "root"), "key", "left_anti")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Null and empty texts have no words and go only where the whole source has none; a null source is
    a source, a null doc_id has a coin of its own and repeated ids share one. An empty table stays empty.
    """
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids.

    A null or empty text is its end id alone; null ids, ties and repeated rows are packed each; a text of
    any length is cut whole; other columns are ignored; an empty table gives an empty result.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Hashing of shingles, learned codes and tokenization have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
