"""Registered queries at the smallest size: against their SQL where there is one, and the pipeline's stages."""

from __future__ import annotations

import duckdb
import pytest

from tallyglass.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    key = lambda row: [(v is not None, v) for v in row]
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(expected, key=key)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = corpus_pipeline.quality(spark, docs, SF).cache()
    assert quality.columns == docs.columns and 0 < quality.count() < docs.count()
    near = corpus_pipeline.near_duplicates(spark, quality, SF).cache()
    assert near.columns == docs.columns and near.count() == near.select("doc_id").distinct().count() <= quality.count()
    cut = corpus_pipeline.repeated_passages(spark, near, SF).cache()
    assert cut.columns == docs.columns and cut.count() <= near.count()
    mixed = corpus_pipeline.mixture(spark, cut, SF).cache()
    assert mixed.columns == docs.columns and mixed.count()
    bins = corpus_pipeline.packing_bins(spark, mixed, SF)
    assert bins.filter("bin_id is null").count() == 0 and bins.groupBy("bin_id").sum("n_words").filter("`sum(n_words)` > 2048").count() == 0


def _odd_documents(spark):
    """Good, bad, copied, repeated, nameless, empty and null rows, with columns named like those that operators add."""
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, rows = write(70), []
    for i in range(60):
        rows.append((i, write(120) + (f" {passage} " + write(30) if i % 6 == 0 else "")))
    words, nameless = rows[3][1].split(" "), write(80)
    rows += [(None, nameless), (None, nameless), (None, rows[3][1])]
    rows += [(100, rows[3][1]), (101, " ".join([*words[:60], "changed", *words[61:]])), (7, rows[7][1]), (8, write(90)), (None, write(80)), (None, write(80)), (102, "short"), (103, None), (104, ""), (105, "same words again " * 40), (106, write(30_000))]
    data = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", 7, 1, "q", True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, rule string, kept boolean")


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from collections import Counter

    import corpus_pipeline
    from tests.llm.test_corpus_operators import WORD, _near, _without

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _odd_documents(spark)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    def fails(text):
        w = WORD.findall(text or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns and {(r["n_words"], r["rule"]) for r in kept.collect()} == {(1, "q")}
    assert pairs(kept) == Counter((r["doc_id"], r["text"]) for r in docs.collect() if not fails(r["text"]))

    near = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path)).cache()
    rows = list({(r["doc_id"], r["text"]) for r in kept.collect()})
    component = _near([(k, t) for k, (_, t) in enumerate(rows)], percent=80)
    least = {}
    for k, (i, t) in enumerate(rows):
        least[component[k][1]] = min(least.get(component[k][1], (i, t)), (i, t), key=lambda x: (x[0] is None, x[0] or 0))
    assert pairs(near) == Counter(least.values()) and sum(i is None for i, _ in least.values()) == 3

    cut = corpus_pipeline.repeated_passages(spark, near, str(tmp_path)).cache()
    named = [(r["doc_id"], r["text"]) for r in near.filter("doc_id is not null").collect() if r["doc_id"] != 8]
    left = _without(named)
    got = {r["doc_id"]: r["text"] for r in cut.filter("doc_id is not null and doc_id <> 8").collect()}
    assert {i: " ".join(WORD.findall(t)) for i, t in got.items()} == {i: t for i, (n, gone, t) in left.items() if gone == 0 or gone < n} and any(gone for _, gone, _ in left.values())
    assert all(r["n_chars"] == len(r["text"]) and r["n_words"] == 1 for r in cut.collect())

    mixed = corpus_pipeline.mixture(spark, cut, str(tmp_path)).cache()
    by_source, taken = Counter(), Counter()
    for r in cut.collect():
        by_source[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    shares = {s: w for s, w in zip(sorted(by_source, key=lambda s: (s is None, s or "")), (5, 2, 1, 5))}
    open_, rest, target = set(by_source), sum(by_source.values()), {}
    while open_:  # fill by weight; what is above three times its source's size stops there
        total = sum(shares[s] for s in open_)
        over = {s for s in open_ if rest * shares[s] / total > 3 * by_source[s]}
        for s in over or open_:
            target[s] = 3 * by_source[s] if over else rest * shares[s] / total
        if not over:
            break
        rest, open_ = rest - sum(3 * by_source[s] for s in over), open_ - over
    assert mixed.columns == docs.columns and all(abs(taken[s] - target[s]) <= 32 for s in by_source)

    bins = corpus_pipeline.packing_bins(spark, mixed, str(tmp_path)).collect()
    assert Counter(w for r in bins for w in WORD.findall(r["text"])) == Counter(w for r in mixed.collect() for w in WORD.findall(r["text"]))
    for b in {r["bin_id"] for r in bins}:
        inside = [r for r in bins if r["bin_id"] == b]
        ids = [r["doc_id"] for r in inside if r["doc_id"] is not None]
        assert sum(r["n_words"] for r in inside) <= 2048 and len(ids) == len(set(ids)) and max(Counter(r["source"] for r in inside).values()) <= 3

    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0, name
