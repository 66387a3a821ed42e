"""Every registered query with SQL gives what the SQL gives, at the smallest size."""

from __future__ import annotations

import math

import duckdb
import pytest

from tallyglass import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    plain = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({plans.SQL[name]})").fetchall()
    got = _rows(map(tuple, df.select(*names).collect()))
    assert got == _rows(expected)
    assert got or name in ("rework_edges", "escalation_edges")


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_document_is_a_call(spark, con):
    got = {r["call_id"]: (r["taint"], r["tier"]) for r in plans.QUERIES["argument_influence"](spark, SF).collect()}
    assert sorted(got) == [i for (i,) in con.sql("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    # four plain words cannot miss the document that they are quoted from
    plain = {i for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if all(w.isascii() and w.isalpha() for w in t.split()[1:5]) and len(t.split()) > 5}
    assert len({i % 5 for i in plain}) == 5 and {got[i][1] for i in plain} == {"traced"}
    assert {got[i][0] for i in plain if i % 20 == 0} <= {"retrieved_untrusted"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
