"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine, as in tests, a temporary folder; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tallyglass-core-")


def stage(df: DataFrame) -> DataFrame:
    """The rows written once and read back, for what several parts of a plan read: they don't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file in any store that Spark knows: written under another name and renamed, so it is there whole or not at all."""
    folder, _, name = path.rpartition("/")
    (final, store), (part, _) = _place(spark, path), _place(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(final):
        if not replace:
            store.delete(part, False)
            raise FileExistsError(f"{path} is there already")
        store.delete(final, False)
    if not store.rename(part, final):
        raise OSError(f"{path} could not be written")


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    place, store = _place(spark, path)
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, without hidden ones; none if it isn't there."""
    place, store = _place(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(place) if not f.getPath().getName().startswith((".", "_"))] if store.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)
