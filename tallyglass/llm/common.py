"""What several corpus operators share: intermediate tables, gapless numbers and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or on one machine, as in tests, a temporary one.

    A machine's own folder would lose data on a cluster, so there the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_scope: ContextVar[str | None] = ContextVar("_scope", default=None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _home(spark: SparkSession) -> str:
    return _scope.get() or f"{shared_folder(spark)}/tallyglass-{spark.sparkContext.applicationId}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators staged within it; results must have been written or collected by then."""
    folder = f"{_home(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Deletes all that operators of this application have staged outside of scratch(); for when no result is read any more."""
    _delete(spark, _home(spark))


def stage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a cut in the lineage that outlives lost executors."""
    path = f"{_home(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, staged; what make() staged itself is deleted, so only the result takes room from then on."""
    path = f"{_home(spark)}/stage-{uuid.uuid4().hex}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small rows of an iteration; Spark removes its files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def repeated(df: DataFrame, n: str, name: str, most: int = 1 << 16) -> DataFrame:
    """Each row n times, numbered from 0 in the column name, by way of arrays of bounded length."""
    rest = F.col(n).cast("long") - 1
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(rest / most))))
    last = F.least(F.lit(most - 1).cast("long"), rest - F.col("_part") * most)
    numbered = parts.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return numbered.withColumn(name, F.col("_part") * most + F.col("_in")).drop("_part", "_in", n)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """All bytes of a text column; the number of groups that operators deal rows into follows from it."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def offsets(df: DataFrame, keys: list[str], by: list[str], value: str | None, name: str, rows: int, group: int = 128) -> DataFrame:
    """Adds the column name: the sum of value over the rows before, in an order of its own within each combination of keys.

    With no value, that is a number from 0 without gaps. Rows are dealt by a hash of the columns ``by``, which should tell
    them apart, into groups of about ``group`` rows, and stand in their order there; each group adds up its own and starts
    from the sum of the groups before it. These sums are added up the same way, 1,024 groups at a time, so no window holds
    more than a group, 1,024 sums or a thousandth of them, whatever the share of a key. Rows equal in ``by`` and value are
    interchangeable, so the result doesn't depend on how rows are partitioned.
    """
    n = max(1, rows // group)
    amount = F.col(value).cast("long") if value else F.lit(1).cast("long")
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(n))).withColumn("_v", amount)
    before = lambda over, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    sums = dealt.groupBy(*keys, "_deal").agg(F.sum("_v").alias("_n"))
    if n <= 1024:
        starts = sums.withColumn("_from", before(keys, "_deal")).drop("_n")
    else:
        sums = sums.withColumn("_many", F.floor(F.col("_deal") / 1024))
        large = sums.groupBy(*keys, "_many").agg(F.sum("_n").alias("_n")).withColumn("_first", before(keys, "_many")).drop("_n")
        small = sums.withColumn("_from", before([*keys, "_many"], "_deal")).alias("s")
        starts = small.join(large.alias("l"), same("s", "l", [*keys, "_many"])).select(*[f"s.{k}" for k in (*keys, "_deal")], (F.col("s._from") + F.col("l._first")).alias("_from"))
    within = Window.partitionBy(*keys, "_deal").orderBy(*by, "_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_at", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = ranked.alias("a").join(starts.alias("b"), same("a", "b", [*keys, "_deal"]))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._at") + F.col("b._from")).alias(name))


def _edges_key(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; edges hold u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """(node, component) for every node of the edges, component being the smallest node reachable.

    Alternating large-star and small-star steps; each is an aggregation and a join on the node, so a hub's rows are
    pre-aggregated and its join can be split. Raises if most rounds do not settle it.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = cut(edges)
    key = _edges_key(edges)
    for _ in range(most):
        if not key[0]:
            break
        edges = cut(_star(_star(edges, True), False))
        new = _edges_key(edges)
        if new == key:
            break
        key = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Rows of vector_parts.
PARTS = "part int, numbers binary"


def vector_parts(vector: np.ndarray, size: int = 512) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows of a few KB."""
    parts = [vector[at : at + size].tobytes() for at in range(0, len(vector), size)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "numbers"])


def vector_sum(partials: DataFrame, length: int, kind: type, size: int = 512, tasks: int = 32) -> np.ndarray:
    """The sum of the vectors that tasks handed out by vector_parts: summed in a few tasks first, so the driver gets ``tasks`` vectors at most."""

    def add(total: np.ndarray, part: int, numbers: bytes) -> None:
        total[part * size : part * size + len(numbers) // total.itemsize] += np.frombuffer(numbers, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(length, kind), False
        for batch in batches:
            for part, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add(total, part, numbers)
                some = True
        if some:
            yield from vector_parts(total, size)

    total = np.zeros(length, kind)
    for row in partials.repartition(tasks).mapInArrow(run, PARTS).collect():
        add(total, row["part"], row["numbers"])
    return total


def words(text: str | Column) -> Column:
    """The array of words of a text, none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
