"""Names for Spark SQL: table functions over texts and scalar functions of statistics, registered in a session.

Table functions run in Python over Arrow batches; scalar ones are SQL expressions, so that Catalyst sees through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallyglass.functions import udfs

_RATE, _ZZ = "(k / n)", "(1.96D * 1.96D / n)"
_MIDDLE = f"({_RATE} + {_ZZ} / 2) / (1 + {_ZZ})"
_HALF = f"1.96D * sqrt({_RATE} * (1 - {_RATE}) / n + {_ZZ} / (4D * n)) / (1 + {_ZZ})"
#: Name, parameters, type and body.
SCALARS = {
    "wilson_lo": ("k BIGINT, n BIGINT", "DOUBLE", f"CASE WHEN n <= 0 THEN 0D ELSE greatest(0D, {_MIDDLE} - {_HALF}) END"),
    "wilson_hi": ("k BIGINT, n BIGINT", "DOUBLE", f"CASE WHEN n <= 0 THEN 0D ELSE least(1D, {_MIDDLE} + {_HALF}) END"),
    "hoeffding_p": ("rate DOUBLE, n BIGINT, alpha DOUBLE", "DOUBLE", "CASE WHEN n <= 0 OR rate >= alpha THEN 1D ELSE exp(-2D * n * (alpha - rate) * (alpha - rate)) END"),
    "always_valid_p": ("max_e DOUBLE", "DOUBLE", "CASE WHEN max_e <= 0 THEN 1D ELSE least(1D, 1 / max_e) END"),
}


@udtf(returnType="idx int, sentence string", useArrow=True)
class SentencesOf:
    """sentences_of(text): the sentences of a text in order, the rest after the last end included."""

    def eval(self, text: str):
        if text:
            done, rest = udfs.split_sentences(text)
            for i, s in enumerate([*done, *([rest.strip()] if rest.strip() else [])]):
                yield i, s


@udtf(returnType="kind string, redacted string, start int, end int, validated boolean", useArrow=True)
class PiiOf:
    """pii_of(text): personal identifiers in a text, with what may be shown of them."""

    def eval(self, text: str):
        for x in udfs.redacted_pii(text):
            yield x["kind"], x["redacted"], x["start"], x["end"], x["validated"]


def register(spark: SparkSession) -> None:
    """Makes sentences_of and pii_of callable in FROM, and the scalar functions anywhere, for as long as the session lasts."""
    spark.udtf.register("sentences_of", SentencesOf)
    spark.udtf.register("pii_of", PiiOf)
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
