"""Recorded model streams as a source: written by Spark, read in batch, or replayed as they arrived.

A recording is a folder of JSON-lines files whose lines stand in the order of arrival: ``{"stream", "at_ms", "raw"}``, raw being
one event of the provider, and lines with ``_meta`` that describe a stream. In a file that names no stream, the file is one.

The replay's offset is a time on the recording's clock, so a micro-batch is the lines of all files that arrived between two
times. In a file the first of them is found by bisection over byte positions, which is also how a restart goes on in the
middle of a file. The clock runs at ``speed`` recorded milliseconds a millisecond from ``startedAt`` (epoch milliseconds) on; both
are options of the stream, so that the clock of a restarted query goes on as well. Without them all is there at once.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyglass.sources import files

FORMAT, SCHEMA = "recorded_streams", "stream string, place long, at_ms double, raw string"
#: Lines of a record batch.
LINES = 2048


@dataclass
class Window(InputPartition):
    """Lines of a file that arrived after one time and not after another."""

    path: str
    after: float
    until: float


def _open(path: str):
    """A file by path or URI, in any store that Arrow reads."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _listed(folder: str) -> list[str]:
    plain = folder if "://" in folder or folder.startswith("file:") else None
    where, name = fs.FileSystem.from_uri(folder) if plain else (fs.LocalFileSystem(), folder)
    found = where.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    prefix = folder[: len(folder) - len(name)] if plain and folder.endswith(name) else ("file://" if plain else "")
    return sorted(prefix + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _line(source, at: int, size: int) -> tuple[int, bytes, int]:
    """The first line that begins at or after a byte, with its own place and the place after it; an empty one at the end."""
    begin = at
    if at:
        begin = at - 1  # a line may begin right here
        while begin < size:
            source.seek(begin)
            block = source.read(1 << 12)
            cut = block.find(b"\n")
            if cut >= 0:
                begin += cut + 1
                break
            begin += len(block)
    source.seek(begin)
    line = b""
    while b"\n" not in line:
        more = source.read(1 << 12)
        if not more:
            break
        line += more
    line = line.split(b"\n", 1)[0]
    return begin, line, begin + len(line) + 1


def _at(line: bytes) -> float:
    return _arrived(json.loads(line))


def _arrived(record: dict) -> float:
    return float(record.get("at_ms", (record.get("_meta") or {}).get("at_ms", 0)))


def begins(source, size: int, after: float) -> int:
    """The place of the first line that arrived after a time, by bisection; the file's size if there is none."""
    low, high = 0, size
    while low < high:
        middle = (low + high) // 2
        place, line, following = _line(source, middle, size)
        if place >= size or not line.strip() or place >= high:
            high = middle
        elif _at(line) > after:
            high = middle
        else:
            low = following
    return _line(source, low, size)[0] if low < size else size


def _read(window: Window) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["stream", "place", "at_ms", "raw"])

    with _open(window.path) as source:
        size = source.size()
        place = begins(source, size, window.after) if window.after >= 0 else 0
        source.seek(place)
        rest = b""
        while place < size:
            block = source.read(1 << 16)
            if not block:
                break
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if place + len(rest) + len(block) < size or block.endswith(b"\n") else b""
            for line in lines:
                if line.strip():
                    record = json.loads(line)
                    if _arrived(record) > window.until:
                        place = size
                        break
                    if "raw" in record:
                        rows.append((record.get("stream") or window.path.rsplit("/", 1)[-1].rsplit(".", 1)[0], place, float(record["at_ms"]), record["raw"]))
                        if len(rows) >= LINES:
                            yield batch()
                            rows = []
                place += len(line) + 1
            else:
                continue
            break
        if rows:
            yield batch()


class Recordings(DataSource):
    """spark.read or spark.readStream .format("recorded_streams"); options path, and for streams speed and startedAt."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Replay(self.options["path"], float(self.options.get("speed", "inf")), float(self.options.get("startedAt", "0")))


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [Window(p, -1.0, float("inf")) for p in _listed(self.path)]

    def read(self, partition: Window | None) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition else iter(())  # Spark asks once where there are none


class _Replay(DataSourceStreamReader):
    def __init__(self, path: str, speed: float, started_at: float):
        self.path, self.speed, self.started_at = path, speed, started_at
        self._end: float | None = None

    def _last(self) -> float:
        """When the last line of all files arrived."""
        if self._end is None:
            self._end = max((self._last_of(p) for p in _listed(self.path)), default=0.0)
        return self._end

    @staticmethod
    def _last_of(path: str) -> float:
        with _open(path) as source:
            size = source.size()
            back = 1 << 12
            while size:
                source.seek(max(0, size - back))
                lines = [x for x in source.read(back).split(b"\n")[back < size :] if x.strip()]
                if lines:
                    return _at(lines[-1])
                if back >= size:
                    break
                back *= 4
        return 0.0

    def initialOffset(self) -> dict:
        return {"at_us": -1000}

    def latestOffset(self) -> dict:
        last = math.ceil(self._last() * 1000)
        if math.isinf(self.speed):
            return {"at_us": last}
        return {"at_us": min(last, max(-1000, int((time.time() * 1000 - self.started_at) * self.speed * 1000)))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["at_us"] <= start["at_us"]:
            return []
        return [Window(p, start["at_us"] / 1000, end["at_us"] / 1000) for p in _listed(self.path)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)


def record(chunks: DataFrame, path: str, files_: int = 8) -> None:
    """Writes chunks (stream, seq, at_ms, delta) as a recording; each stream begins with its meta line and ends with [DONE].

    Times are kept to the microsecond, as the replay's offsets are.
    """
    at = F.round("at_ms", 3)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.coalesce("delta", F.lit("")).alias("content")).alias("delta"))).alias("choices")))
    lines = chunks.select("stream", "seq", at.alias("at_ms"), body.alias("raw"))
    ends = lines.groupBy("stream").agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), F.max("seq").alias("seq"), F.count("*").alias("n"))
    done = ends.select("stream", (F.col("seq") + 1).alias("seq"), F.col("last").alias("at_ms"), F.lit("[DONE]").alias("raw"))
    told = F.struct("stream", F.col("first").alias("at_ms"), (F.col("last") - F.col("first")).alias("total_ms"), (F.col("n") + 1).alias("line_count"))
    meta = ends.select("stream", F.lit(-1).cast("long").alias("seq"), F.col("first").alias("at_ms"), F.to_json(F.struct(told.alias("_meta"))).alias("value"))
    text = lines.unionByName(done).select("stream", F.col("seq").cast("long").alias("seq"), "at_ms", F.to_json(F.struct("stream", "at_ms", "raw")).alias("value"))
    text.unionByName(meta).repartition(files_, "stream").sortWithinPartitions("at_ms", "stream", "seq").select("value").write.mode("overwrite").text(path)


def replayed(spark: SparkSession, path: str, speed: float | None = None, started_at: float | None = None) -> DataFrame:
    """A recording as a stream, with the text of each event and whether it ends its stream."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path)
    if speed:
        reader = reader.option("speed", speed).option("startedAt", started_at if started_at is not None else time.time() * 1000)
    return _texts(reader.load())


def recorded(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return _texts(spark.read.format(FORMAT).option("path", path).load())


def _texts(rows: DataFrame) -> DataFrame:
    done = F.col("raw") == "[DONE]"
    return rows.withColumn("done", done).withColumn("delta", F.when(done, F.lit("")).otherwise(files.delta_text(F.col("raw"))))
