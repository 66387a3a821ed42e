"""A corpus pipeline: quality rules, near-duplicates, repeated passages, mixing to weights, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import common, minhash, mixing, packing, repeats, rules


def _rest(docs: DataFrame) -> Column:
    """All columns but the text as one, so that no operator takes them for its own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")


def _whole(docs: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col("text") if c == "text" else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject; columns named like the counts stay as they are."""
    learned = rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.judged(docs.select("text", _rest(docs)), learned).filter("kept").select(*_whole(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones; copies under one id become one row.

    Different texts under one id are documents of their own. Rows without an id are compared like all others and give way to
    rows with one; of a group in which none has an id, one row stays. Texts without words are similar to nothing.
    """
    numbered = common.stage(docs.withColumn("_pipe_row", F.monotonically_increasing_id()))

    def least() -> DataFrame:
        # at 0.8, 24 bands of four meet with probability 1 - 3e-6
        rows = numbered.select(F.col("_pipe_row").alias("doc_id"), "text", F.col("doc_id").alias("age"))
        found = minhash.near_duplicates(rows, percent=80, width=5, permutations=48, oldest="age")
        found = found.select(F.col("doc_id").alias("_pipe_row"), "n_shingles", "component_id")
        ids = numbered.select("_pipe_row", "doc_id", F.xxhash64("text").alias("_text"))
        # texts without words have a component each: there only copies under one id are similar
        some, none = F.col("n_shingles") > 0, F.col("doc_id").isNull()
        group = [some, F.when(some, F.col("component_id")), F.when(~some & none, F.col("_pipe_row")), *[F.when(~some, F.col(c)) for c in ("doc_id", "_text")]]
        first = F.min(F.struct(none.alias("_none"), "doc_id", "_text", "_pipe_row")).alias("_least")
        joined = found.join(ids.hint("merge"), "_pipe_row")
        return joined.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(group)]).agg(first).select(F.col("_least._pipe_row").alias("_pipe_row"))

    kept = common.finished(spark, least)
    return numbered.join(kept.hint("merge"), "_pipe_row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; n_chars follows, and texts left empty go."""
    left = repeats.without_repeats(docs.select("doc_id", "text", _rest(docs)), width=20, join_words=False)
    return left.filter("n_removed = 0 or n_removed < n_words").select(*_whole(docs, n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as rows of documents."""
    return mixing.mixed_texts(docs)


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of texts with the training sequence that each is packed into; no sequence holds two of one document."""
    return packing.packed(docs, with_text=True, cluster=F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixture", mixture),
    ("best_fit_packing", packing_bins),
]

#: The learned list, the mix's draws and the bins can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next; what a stage staged goes once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = f"{common.shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with common.scratch(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
