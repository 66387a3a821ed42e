"""Files in and out: JSON lines, pairs, outcomes, corpora, uploads, token streams, ledgers, evidence."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass import schemas
from tallyglass.operators import ledger as reads

#: Names of the event kinds that a stream may carry, keys that never leave, and the size limit of an upload.
EVENTS = ("signal", "decision", "tool", "route")
SECRET_KEYS = frozenset({"resume_token", "api_key", "authorization", "token", "secret", "password"})
UPLOAD_LIMIT = 2 * 1024 * 1024


def create_ledger(spark: SparkSession, root: str) -> list[str]:
    """Empty tables for those of the ledger that aren't there yet; the names of those made."""
    made = []
    for table in schemas.TABLES:
        try:
            spark.read.schema(schemas.TABLES[table]).parquet(f"{root}/{table}").limit(0).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            schemas.empty(spark, table).write.parquet(f"{root}/{table}")
            made.append(table)
    return made


def open_table(spark: SparkSession, root: str, table: str, version: str = "ts") -> DataFrame:
    """A table's current rows, the last version of each key; a bag is read as it is."""
    rows = spark.read.schema(schemas.TABLES[table]).parquet(f"{root}/{table}")
    keys = schemas.KEYS[table]
    return reads.latest(rows, keys, version) if keys and version in rows.columns else rows


def append(df: DataFrame, root: str, table: str) -> None:
    """Rows of a table; columns that df doesn't have are null."""
    kinds = T._parse_datatype_string(schemas.TABLES[table]).fields
    full = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
    df.select(*full).write.mode("append").parquet(f"{root}/{table}")


def persist_pairs(df: DataFrame, root: str) -> None:
    """Fairness pairs; empty or equal ids raise before anything is written for their partition."""
    wrong = F.col("base_request_id").isNull() | F.col("twin_request_id").isNull() | (F.col("base_request_id") == "") | (F.col("twin_request_id") == "") | (F.col("base_request_id") == F.col("twin_request_id"))
    checked = df.withColumn("pair_id", F.when(wrong, F.raise_error(F.lit("a pair needs two different requests"))).otherwise(F.col("pair_id")))
    append(checked, root, "fairness_pairs")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped and a malformed one raises with its text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T._parse_datatype_string(f"{schema}, _corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    checked = parsed.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80)))).otherwise(F.col("r")))
    return checked.select("r.*").drop("_corrupt")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


PAIR = "pair_id string, base_request_id string, twin_request_id string, attribute string, decision_field string, base_value string, twin_value string, delta double, offline boolean"


def read_pairs(spark: SparkSession, path: str, accept_offline: bool = False) -> DataFrame:
    """Fairness pairs from one object, an object with pairs, or JSON lines; offline ones only if that is accepted."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", f"pairs array<struct<{PAIR.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>, offline boolean").alias("r"))
    if whole.filter("r.pairs is not null").limit(1).count():
        rows = whole.select(F.explode("r.pairs").alias("p"), F.col("r.offline").alias("_all")).select("p.*", "_all").withColumn("offline", F.coalesce("offline", "_all")).drop("_all")
    else:
        rows = read_json_lines(spark, path, PAIR)
    if not accept_offline:
        rows = rows.withColumn("pair_id", F.when(F.col("offline"), F.raise_error(F.lit("pairs of an offline run need to be accepted"))).otherwise(F.col("pair_id")))
    return rows.filter("base_request_id is not null and twin_request_id is not null")


def read_outcomes(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """Forced outcomes of known items, each (item, action, defect) once; anything else raises."""
    rows = read_json_lines(spark, path, "item_id string, action string, defect string, removed boolean")
    known = items.select(F.col("item_id").cast("string").alias("item_id")).distinct().withColumn("_known", F.lit(True))
    counted = rows.join(known, "item_id", "left").groupBy("item_id", "action", "defect").agg(F.count("*").alias("_n"), F.first("removed").alias("removed"), F.first("_known").alias("_known"))
    wrong = F.when(F.col("_known").isNull(), F.lit("unknown item")).when(F.col("_n") > 1, F.lit("repeated outcome")).when(F.col("removed").isNull() | F.col("action").isNull() | F.col("defect").isNull(), F.lit("missing field"))
    return counted.withColumn("item_id", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(" "), F.col("item_id")))).otherwise(F.col("item_id"))).select("item_id", "action", "defect", "removed")


def read_corpus(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Documents of a manifest with their texts. Strictly, every file is listed and every listed file is there."""
    kind = "documents array<struct<doc_id:string,title:string,domain:string,contradicts:string,provenance:string,tags:array<string>,path:string>>"
    listed = spark.read.schema(kind).option("multiLine", True).json(f"{root}/manifest.json").select(F.explode("documents").alias("d")).select("d.*")
    files = spark.read.text(f"{root}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"), F.col("value").alias("text"))
    both = listed.join(files, "path", "full")
    if strict:
        wrong = F.when(F.col("text").isNull(), F.lit("missing file ")).when(F.col("doc_id").isNull(), F.lit("file that isn't listed ")).when(~F.col("provenance").isin(*schemas.PROVENANCE), F.lit("unknown label of "))
        return both.withColumn("path", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("path")))).otherwise(F.col("path")))
    return both.filter("text is not null and doc_id is not null")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Text uploads as untrusted fragments; those over the limit are left out and those that aren't text are empty."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= UPLOAD_LIMIT)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("text"), F.lit("retrieved_untrusted").alias("provenance"))


def fragments(body: Column) -> Column:
    """Fragments that a caller gives; what has no label is untrusted."""
    given = F.from_json(body, "array<struct<text:string,provenance:string,domain:string,doc_id:string,score:double>>")
    return F.transform(given, lambda f: f.withField("provenance", F.coalesce(f["provenance"], F.lit("retrieved_untrusted"))))


def sse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Data lines of an event stream: comments and named events are left out, [DONE] is marked, other payloads are kept raw."""
    data = lines.filter(F.startswith(F.col(column), F.lit("data:"))).withColumn("payload", F.trim(F.substring(column, 6, 1 << 30)))
    return data.withColumn("done", F.col("payload") == "[DONE]").withColumn("json", F.try_parse_json(F.when(~F.col("done"), F.col("payload")))).withColumn("delta", delta_text(F.col("payload")))


def delta_text(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.choices[0].delta.content"), F.get_json_object(payload, "$.choices[0].message.content"), F.lit(""))


def sse_frames(texts: DataFrame, column: str = "value") -> DataFrame:
    """Frames of whole event-stream texts: event, joined data, and a note on frames without data or with broken JSON."""
    frames = texts.select(F.posexplode(F.split(column, r"\r?\n\r?\n")).alias("seq", "frame")).filter(F.trim("frame") != "")
    lines = F.split("frame", r"\r?\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(name + ":"))), lambda x: F.ltrim(F.regexp_replace(x, f"^{name}:", "")))
    data = F.array_join(field("data"), "\n")
    out = frames.select("seq", F.coalesce(F.get(field("event"), F.lit(0)), F.lit("message")).alias("event"), data.alias("data"))
    broken = (F.col("data") != "[DONE]") & F.try_parse_json("data").isNull()
    return out.withColumn("note", F.when(F.col("data") == "", "no data").when(broken, "broken JSON"))


def sse_text(event: Column, data: Column) -> Column:
    """A named frame; a name that isn't known raises."""
    known = F.when(event.isin(*EVENTS), event).otherwise(F.raise_error(F.concat(F.lit("unknown event "), event)))
    return F.concat(F.lit("event: "), known, F.lit("\ndata: "), data, F.lit("\n\n"))


def recorded_stream(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of recorded token streams (JSON lines, the first a header), with their text."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.get_json_object("value", "$._meta").isNull())
    return rows.select("file", F.get_json_object("value", "$.at_ms").cast("double").alias("at_ms"), F.get_json_object("value", "$.raw").alias("raw")).withColumn("delta", delta_text(F.col("raw")))


def redacted(value, canaries: tuple[str, ...] = ()):
    """A value without secret keys, canaries replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.lower() in SECRET_KEYS else redacted(v, canaries) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v, canaries) for v in value]
    if isinstance(value, str):
        for canary in canaries:
            value = re.sub(re.escape(canary), "[CANARY]", value)
    return value


def evidence(spark: SparkSession, root: str, request_id: str, canaries: tuple[str, ...] = ()) -> tuple[bytes, list[str]]:
    """A ZIP of all that the ledger has on one request, and what is missing. A request's rows are few, so they come to the driver."""
    found, missing, sink = {}, [], io.BytesIO()
    for table in ("requests", "signals", "decisions", "spend", "tool_calls", "holds"):
        rows = spark.read.schema(schemas.TABLES[table]).parquet(f"{root}/{table}").filter(F.col("request_id") == request_id)
        found[table] = [redacted(json.loads(r[0]), canaries) for r in rows.select(F.to_json(F.struct("*"))).collect()]
        if not found[table]:
            missing.append(table)
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("manifest.json", json.dumps({"request_id": request_id, "rows": {t: len(r) for t, r in found.items()}, "missing": missing}, sort_keys=True))
        for table, rows in found.items():
            out.writestr(f"{table}.json", json.dumps(rows, sort_keys=True, ensure_ascii=False))
    return sink.getvalue(), missing
