"""A store of retrieval indexes: whole versions side by side, one of which counts.

A build writes chunks, postings, vectors and what it was made with to a folder of its own, checks them, and only then puts down
a manifest with the next number. The manifest with the largest number says which version counts, so a build that fails or is
still running changes nothing, and a reader that has opened a version keeps it while others are built. Chunks and
vectors lie in buckets of their id, so that point reads look at the buckets they need and no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import seams, storage
from tallyglass.operators import retrieval

CHUNK = ("chunk_id", "doc_id", "title", "text", "domain", "provenance", "ordinal")
#: Chunks of a bucket that a build aims at.
PER_BUCKET = 50_000


class IndexRefused(ValueError):
    """An index that was made with other parts than it is opened with, or that its own parts contradict."""


def _bucket(chunk_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, root: str, embedder: str, dim: int, corpus_version: str = "") -> int:
    """Writes a version from chunks (CHUNK; what is missing is null) and makes it the one that counts; its number.

    Chunk ids have to be unique, and every vector has to have the width that the embedder declares.
    """
    spark, folder = chunks.sparkSession, f"versions/{uuid.uuid4().hex}"
    path = f"{root}/{folder}"
    n, distinct = chunks.agg(F.count("*"), F.count_distinct("chunk_id")).first()
    if n != distinct:
        raise IndexRefused(f"{n - distinct} chunks repeat the id of another or have none")
    buckets = max(1, -(-n // PER_BUCKET))
    whole = chunks.select(*[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in CHUNK]).withColumn("_bucket", _bucket(F.col("chunk_id"), buckets))
    dealt = whole.repartition(buckets, "_bucket")
    dealt.write.partitionBy("_bucket").parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks") if n else dealt
    vectors = kept.select("chunk_id", seams.encoded("passage", embedder, F.col("text")).alias("embedding"), "_bucket")
    vectors.write.partitionBy("_bucket").parquet(f"{path}/vectors")
    if n:
        wrong = spark.read.parquet(f"{path}/vectors").filter(F.col("embedding").isNull() | (F.size("embedding") != dim)).agg(F.count("*"), F.max(F.size("embedding"))).first()
        if wrong[0]:
            raise IndexRefused(f"{embedder} declares {dim} components and made {wrong[1]}")
    retrieval.postings(kept.select("chunk_id", "text"), "chunk_id").write.parquet(f"{path}/postings")
    number = max(numbers(spark, root), default=0) + 1
    told = {"number": number, "folder": folder, "embedder": embedder, "dim": dim, "chunks": n, "buckets": buckets, "corpus_version": corpus_version}
    storage.put(spark, f"{root}/manifests/{number:012d}.json", json.dumps(told, sort_keys=True), replace=False)
    return number


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that were finished."""
    return sorted(int(name.split(".")[0]) for name in storage.names(spark, f"{root}/manifests") if name.endswith(".json"))


@dataclass(frozen=True)
class Index:
    """One version, pinned: what is built later doesn't change it."""

    spark: SparkSession
    root: str
    number: int
    folder: str
    embedder: str
    dim: int
    chunks: int
    buckets: int
    corpus_version: str

    def _table(self, name: str) -> DataFrame:
        if not self.chunks:
            kinds = {"chunks": ", ".join(f"{c} string" for c in CHUNK), "vectors": "chunk_id string, embedding array<float>", "postings": "term string, chunk_id string, length int, tf long"}
            return self.spark.createDataFrame([], kinds[name] + ("" if name == "postings" else ", _bucket int"))
        return self.spark.read.parquet(f"{self.root}/{self.folder}/{name}")

    def all_chunks(self) -> DataFrame:
        return self._table("chunks").drop("_bucket")

    def postings(self) -> DataFrame:
        return self._table("postings")

    def vectors(self) -> DataFrame:
        return self._table("vectors").drop("_bucket")

    def get(self, chunk_ids: list[str], table: str = "chunks") -> DataFrame:
        """Rows of some ids; only their buckets are read, and within them what the files' statistics leave."""
        ids = self.spark.createDataFrame([(i,) for i in chunk_ids], "chunk_id string")
        wanted = [r[0] for r in ids.select(_bucket(F.col("chunk_id"), self.buckets)).distinct().collect()]
        return self._table(table).filter(F.col("_bucket").isin(wanted) & F.col("chunk_id").isin(chunk_ids)).drop("_bucket")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows of any number of ids (chunk_id), joined bucket by bucket."""
        asked = ids.select("chunk_id").distinct().withColumn("_bucket", _bucket(F.col("chunk_id"), self.buckets))
        return self._table("chunks").join(asked, ["_bucket", "chunk_id"], "left_semi").drop("_bucket")


def open_index(spark: SparkSession, root: str, embedder: str, dim: int, number: int | None = None) -> Index:
    """The version that counts, or one by its number; refused before any read if it was made with other parts."""
    there = numbers(spark, root)
    if not there or (number is not None and number not in there):
        raise IndexRefused(f"there is no finished index{'' if number is None else f' {number}'} at {root}")
    told = json.loads(storage.get(spark, f"{root}/manifests/{number or there[-1]:012d}.json"))
    if (told["embedder"], told["dim"]) != (embedder, dim):
        raise IndexRefused(f"the index was made with {told['embedder']} of {told['dim']} components, not {embedder} of {dim}")
    return Index(spark, root, **told)


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest versions, manifests first; the numbers that went. Readers of these lose them."""
    gone = numbers(spark, root)[:-keep] if keep else numbers(spark, root)
    for number in gone:
        told = json.loads(storage.get(spark, f"{root}/manifests/{number:012d}.json"))
        storage.delete(spark, f"{root}/manifests/{number:012d}.json")
        storage.delete(spark, f"{root}/{told['folder']}")
    return gone
