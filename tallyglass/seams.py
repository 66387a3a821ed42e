"""Where a user's own parts go in: named functions over columns or frames, looked up by kind and name.

A risk engine makes a map of probabilities, a detector a struct of raw value and finding, an embedder an array, a judge and a
difficulty a number, all from columns; a retriever, a provider and a console source make frames. Parts are registered once
and then named in a configuration; an unknown name is an error that lists what there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import text, udfs
from tallyglass.operators import control

KINDS = ("engine", "detector", "embedder", "injection", "difficulty", "repair", "judge", "retriever", "provider", "console")
_parts: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, part: Callable) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    _parts[kind, name] = part
    return part


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _parts if k == kind)


def resolve(kind: str, name: str) -> Callable:
    if (kind, name) not in _parts:
        raise ValueError(f"no {kind} is named {name}; there are {', '.join(names(kind)) or 'none'}")
    return _parts[kind, name]


def encoded(kind_of_text: str, embedder: str, column: Column) -> Column:
    """The vector of a query or a passage: an embedder may have a form of its own for queries."""
    own = f"{embedder}/query"
    return resolve("embedder", own if kind_of_text == "query" and ("embedder", own) in _parts else embedder)(column)


def stub_engine(directive: Column, sentence_idx: Column) -> Column:
    """Only what a directive forces for this very sentence; a directive has defect, sentence and p."""
    forced = directive.isNotNull() & (directive["sentence"] == sentence_idx)
    return F.when(forced, F.create_map(directive["defect"], directive["p"])).otherwise(F.create_map().cast("map<string,double>"))


def stipulated_engine(defective: Column, defect: Column, floor: float = 0.02, ceiling: float = 0.95) -> Column:
    """A declared probability instead of a measured one: the ceiling for what is known to be defective, the floor for the rest."""
    return F.create_map(defect, F.when(defective, F.lit(ceiling)).otherwise(F.lit(floor)))


def nothing_retrieved(spark: SparkSession) -> DataFrame:
    """The retriever that finds nothing."""
    return spark.createDataFrame([], "query_id long, doc_id long, score double, rank long")


register("engine", "stub", stub_engine)
register("engine", "stipulated", stipulated_engine)
register("detector", "injection", text.injection)
register("detector", "canary", lambda t: t.rlike(r"(?i)\bIL-CANARY-[A-Za-z0-9_-]+\b").cast("double"))
register("injection", "grammar", text.injection)
register("difficulty", "heuristic", text.difficulty)
register("embedder", "hash", lambda t: udfs.hash_embed(t))
register("judge", "overlap", control.overlap)
register("retriever", "null", nothing_retrieved)
