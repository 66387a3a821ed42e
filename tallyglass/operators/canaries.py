"""Planted strings that leave with a text: any number of strings of any shape, found in one pass over each text.

The strings become Aho-Corasick automata. One automaton holds strings of SLICE_BYTES at most and is built once a Python worker,
so that a task's memory doesn't follow the registry; larger registries are dealt into several, each with a pass of its own over the
texts. Texts are never shuffled.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings in one automaton at most (a single longer string has its own); it takes some fifty times that in memory.
SLICE_BYTES = 4 << 20
#: Fixed value: how a minted string begins.
PREFIX = "IL-CANARY"
FOUND = "text_id long, tenant string, canary string, owner string, start int, end int"

_built: dict[str, ahocorasick.Automaton] = {}


def minted(spark: SparkSession, tenants: DataFrame, each: int = 1) -> DataFrame:
    """(canary, owner): new random strings for each tenant; write them down at once, as every look makes others."""
    make = F.udf(lambda tenant, _: f"{PREFIX}-{str(tenant).upper()}-{secrets.token_hex(8).upper()}", "string").asNondeterministic()
    return tenants.select(F.col("tenant").cast("string").alias("owner"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_i")).select(make("owner", "_i").alias("canary"), "owner")


def registered(rows: DataFrame) -> DataFrame:
    """(canary, owner), each string once; empty strings are no canaries, and one string of two owners raises."""
    some = rows.select(F.col("canary").cast("string").alias("canary"), F.col("owner").cast("string").alias("owner")).filter("canary <> ''")
    one = some.groupBy("canary").agg(F.min("owner").alias("owner"), F.max("owner").alias("_other"))
    return one.select("canary", F.when(F.col("owner").eqNullSafe(F.col("_other")), F.col("owner")).otherwise(F.raise_error(F.lit("a canary has two owners"))).alias("owner"))


def hidden(canary: Column) -> Column:
    """A canary to be shown: enough to tell it from others, never enough to repeat it."""
    return F.when(F.length(canary) > 20, F.concat(F.substring(canary, 1, 12), F.lit("..."), F.substring(canary, -4, 4))).otherwise(F.concat(F.substring(canary, 1, 4), F.lit("...")))


def _slices(registry: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The registry in slices of bounded size, one after the other to the driver."""
    sized = registry.withColumn("_bytes", F.octet_length("canary"))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    n = -(-total * 2 // SLICE_BYTES)  # half full on average, so that no slice of a hash gets far over the bound
    for k in range(n):
        held, size = [], 0
        for row in sized.filter(F.pmod(F.xxhash64("canary"), F.lit(n)) == k).toLocalIterator():
            if held and size + row["_bytes"] > SLICE_BYTES:
                yield held
                held, size = [], 0
            held.append((row["canary"], row["owner"]))
            size += row["_bytes"]
        if held:
            yield held


def _automaton(name: str, slice_: list[tuple[str, str | None]]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for canary, owner in slice_:
            made.add_word(canary, (canary, owner))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def _passed(texts: DataFrame, slice_: list[tuple[str, str | None]]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(slice_)
    name = secrets.token_hex(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        names = ["text_id", "tenant", "canary", "owner", "start", "end"]
        for batch in batches:
            automaton = _automaton(name, sent.value)
            rows: list[tuple] = []
            for text_id, tenant, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first: dict[str, tuple] = {}
                for end, (canary, owner) in automaton.iter(text or ""):
                    first.setdefault(canary, (text_id, tenant, canary, owner, end + 1 - len(canary), end + 1))
                rows += first.values()
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return texts.mapInArrow(run, FOUND)


def hits(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(text_id, canary, owner, start, end, cross_tenant): where each string of the registry first stands in each text.

    texts has text_id (long), tenant and text. Any registered string counts, whoever owns it; cross_tenant tells that it isn't
    the text's own tenant, and a text without a tenant accuses nobody. Case matters. Null and empty texts hold nothing.
    """
    rows = texts.select(F.col("text_id").cast("long").alias("text_id"), F.col("tenant").cast("string").alias("tenant"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    found = None
    for slice_ in _slices(registered(registry)):
        part = _passed(rows, slice_)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.sparkSession.createDataFrame([], FOUND)
    cross = F.coalesce(~F.col("owner").eqNullSafe(F.col("tenant")) & F.col("tenant").isNotNull(), F.lit(False))
    return found.select("text_id", "canary", "owner", "start", "end", cross.alias("cross_tenant"))


def verdicts(found: DataFrame) -> DataFrame:
    """(text_id, action, reason, canaries, cross_tenant): a text that repeats any canary is blocked; no probability is asked."""
    first = F.min(F.struct("start", "end", "canary", "owner", "cross_tenant"))
    told = found.groupBy("text_id").agg(first.alias("f"), F.count("*").alias("canaries"), F.max("cross_tenant").alias("cross_tenant"))
    whose = F.when(F.col("f.cross_tenant"), F.lit("another tenant's")).otherwise(F.lit("the tenant's own"))
    return told.select("text_id", F.lit("L5_block").alias("action"), F.concat(whose, F.lit(" canary "), hidden(F.col("f.canary"))).alias("reason"), "canaries", "cross_tenant")


def planted(contexts: DataFrame, registry: DataFrame) -> DataFrame:
    """(tenant, registered, planted) for every tenant of contexts (text_id, tenant, text): its canaries, and those that stand in its own contexts."""
    own = registered(registry).groupBy(F.col("owner").alias("tenant")).agg(F.count("*").alias("registered"))
    met = hits(contexts, registry).filter("not cross_tenant").groupBy(F.col("owner").alias("tenant")).agg(F.count_distinct("canary").alias("planted"))
    tenants = contexts.select(F.col("tenant").cast("string").alias("tenant")).distinct()
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tenants.join(own, "tenant", "left").join(met, "tenant", "left").select("tenant", some("registered"), some("planted"))
