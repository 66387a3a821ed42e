"""Passages added to the context of evaluation items: drawn without replacement from a numbered pool, past what is excluded.

The pool's documents are numbered in the order of domain and id. What an item may not get is a handful of intervals of these
numbers: its own domain, which is one, and the single documents that it has already. A draw picks a number below what is left
and skips the intervals that begin at or before it, so that no item ever meets a domain or the pool; the number found is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import storage
from tallyglass.functions import folds

#: The label that makes a document safe to add, and how many a level of difficulty adds.
SAFE, ADDED = "retrieved_verified", {"L1_direct": 0, "L2_distractor": 1, "L3_conflict": 2}


def pool_of(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, place): the documents that may be added, numbered in the order of domain and id."""
    safe = docs.filter((F.col("provenance") == SAFE) & F.col("domain").isNotNull()).select("doc_id", "domain")
    return storage.stage(folds.placed(safe, [], ["domain", "doc_id"]).select("doc_id", "domain", F.col("_at").alias("place")))


def skipped(place: Column, gaps: Column) -> Column:
    """The place-th number that lies in none of the gaps, which are (start, size) in order and don't overlap."""
    return F.aggregate(gaps, place, lambda at, gap: F.when(gap["start"] <= at, at + gap["size"]).otherwise(at))


def _draw(item: Column, n: int, seed: int, below: Column) -> Column:
    """A number below another, from a hash of the item and the draw."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), item.cast("string"), F.lit(str(n))))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), below)


def additions(items: DataFrame, docs: DataFrame, seed: int = 7) -> DataFrame:
    """(item_id, draw, doc_id): what each item's context gets, 0, 1 or 2 documents by its level, none twice.

    items has item_id, level, domain and context (ids of documents that it holds already, its source included). An added document
    is safe, of another domain and not in the context. An item for which too few are left raises, as does an unknown level.
    """
    pool = pool_of(docs)
    total = pool.count()
    domains = pool.groupBy("domain").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    wanted = F.coalesce(*[F.when(F.col("level") == level, F.lit(n)) for level, n in ADDED.items()], F.raise_error(F.concat(F.lit("unknown level "), F.coalesce("level", F.lit("null")))).cast("int"))
    asking = items.select("item_id", "domain", "context", wanted.alias("wanted")).filter("wanted > 0")
    held = asking.select("item_id", F.explode(F.array_distinct("context")).alias("doc_id")).join(pool, "doc_id")
    held = held.groupBy("item_id").agg(F.collect_list(F.struct(F.col("place").alias("start"), F.lit(1).cast("long").alias("size"), "domain")).alias("held"))
    own = F.when(F.col("size").isNotNull(), F.array(F.struct("start", "size"))).otherwise(F.array())
    single = F.transform(F.filter(F.coalesce("held", F.array()), lambda x: ~x["domain"].eqNullSafe(F.col("domain"))), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))
    rows = asking.join(domains, "domain", "left").join(held, "item_id", "left").withColumn("gaps", F.array_sort(F.concat(own, single)))
    left = F.lit(total) - F.aggregate("gaps", F.lit(0).cast("long"), lambda acc, g: acc + g["size"])
    rows = rows.withColumn("left", F.when(left >= F.col("wanted"), left).otherwise(F.raise_error(F.concat(F.lit("too few safe documents for item "), F.col("item_id").cast("string"))).cast("long")))
    rows = rows.withColumn("p1", skipped(_draw(F.col("item_id"), 1, seed, F.col("left")), F.col("gaps")))
    more = F.array_sort(F.concat("gaps", F.array(F.struct(F.col("p1").alias("start"), F.lit(1).cast("long").alias("size")))))
    rows = rows.withColumn("p2", F.when(F.col("wanted") > 1, skipped(_draw(F.col("item_id"), 2, seed, F.col("left") - 1), more)))
    drawn = rows.select("item_id", F.posexplode(F.filter(F.array("p1", "p2"), lambda p: p.isNotNull())).alias("_i", "place"))
    return drawn.join(pool.select("place", "doc_id"), "place").select("item_id", (F.col("_i") + 1).alias("draw"), "doc_id")


def contradictions(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, context, answer, offending): items of a contradiction, with the passage that contradicts beside their own.

    items has item_id, source and partner; docs has doc_id, text and contradicts. The partner has to contradict the source
    itself, not the other way round, and its passage may not be empty; otherwise this raises.
    """
    partner = docs.select(F.col("doc_id").alias("partner"), F.col("contradicts"), F.trim("text").alias("_body"))
    both = items.join(partner, "partner", "left")
    wrong = (
        F.when(F.col("_body").isNull() | ~F.col("contradicts").eqNullSafe(F.col("source")), F.lit("the contradiction's direction is wrong for item "))
        .when(F.col("_body") == "", F.lit("the contradicting passage is empty for item "))
    )
    answer = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("item_id").cast("string")))).otherwise(F.col("_body"))
    return both.select("item_id", F.array("source", "partner").alias("context"), answer.alias("answer")).withColumn("offending", F.col("answer"))
