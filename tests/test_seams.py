"""Parts by name, and indexes that refuse what they weren't made for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyglass import seams
from tallyglass.operators import control, retrieval, seeded


def test_parts_are_found_by_name(spark):
    assert seams.names("engine") == ["stipulated", "stub"] and seams.resolve("retriever", "null")(spark).count() == 0
    with pytest.raises(ValueError, match="stipulated, stub"):
        seams.resolve("engine", "oracle")
    with pytest.raises(ValueError, match="none of"):
        seams.register("gadget", "x", len)
    seams.register("embedder", "hash/query", lambda c: F.array(F.lit(1.0)))
    try:
        df = spark.createDataFrame([("fees of loans",)], "t string").select(F.size(seams.encoded("query", "hash", F.col("t"))).alias("q"), F.size(seams.encoded("passage", "hash", F.col("t"))).alias("p"))
        assert tuple(df.first()) == (1, 256)
    finally:
        del seams._parts["embedder", "hash/query"]


def test_an_index_of_another_embedder_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a fee and a loan"), (2, "a fee"), (3, None), (4, "")], "doc_id long, text string")
    retrieval.write_index(docs, str(tmp_path), "hash", 256)
    assert {(r["term"], r["doc_id"]): r["tf"] for r in retrieval.open_index(spark, str(tmp_path), "hash", 256).collect()}["a", 1] == 2
    for name, dim in (("hash", 64), ("other", 256)):
        with pytest.raises(ValueError, match="was made with hash of 256"):
            retrieval.open_index(spark, str(tmp_path), name, dim)


def test_nearest_vectors_in_blocks_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 30)
    v = spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    q = v.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = [sorted(map(tuple, retrieval.knn(q, v, 5, broadcast=b).collect())) for b in (1000, 3)]
    assert found[0] == found[1] and len(found[0]) == 5 * q.count()


def test_conflicting_gold_labels_raise(spark):
    df = spark.createDataFrame([(1, 1)], "a int, b int").select(control.gold_label(F.col("a"), F.col("b")))
    with pytest.raises(Exception, match="conflicting"):
        df.collect()


def test_few_documents_leave_the_last_families_short(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(150)] + [(150, None)], "doc_id long, text string")
    got = seeded.seeded_cases(docs).groupBy("family").count().collect()
    assert {r["family"]: r["count"] for r in got} == {"clean": 140, "induced": 11}
    assert seeded.seeded_cases(docs.limit(0)).count() == 0


def test_a_judge_sees_few_requests():
    from tallyglass.operators import detail

    detail.judge_sampled(F.lit(1), 0.05)
    with pytest.raises(ValueError, match="at most 5%"):
        detail.judge_sampled(F.lit(1), 0.06)


def _odd_vectors(spark, n=120):
    import math
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(20)]  # copies
    rows += [(n + 20, [0.0] * 6), (n + 21, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 22, [1.0, 2.0]), (n + 23, [math.nan] * 6), (n + 24, None), (n + 25, []), (n + 26, [1e200] * 6), (n + 27, [1e-200] * 6)]
    return spark.createDataFrame([(i, i % 3, v) for i, v in rows], "vec_id long, part long, embedding array<double>")


def test_cached_answers_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CACHE_BLOCK", 20)
    monkeypatch.setattr(retrieval, "PROBE_BLOCK", 9)
    v = _odd_vectors(spark).select("vec_id", "embedding", F.lit(1).alias("context"), F.lit(1).alias("policy"), F.lit("a").alias("scope"))
    probes, cached = v.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "probe_id"), v.filter("vec_id % 3 > 0").withColumnsRenamed({"vec_id": "cache_id", "embedding": "c"})
    cached = cached.unionByName(cached.filter("cache_id in (121, 124, 140, 143, 146)").withColumn("cache_id", F.col("cache_id") + 100))
    for least in (0.3, 0.95, -1.0):
        pairs = probes.select("probe_id", "embedding").crossJoin(cached.select("cache_id", "c")).withColumn("s", F.round(retrieval.cosine(F.col("embedding"), F.col("c")), 9)).filter(F.col("s") >= least)
        best = {}
        for r in pairs.collect():
            best[r["probe_id"]] = max(best.get(r["probe_id"], (-9, 0)), (r["s"], -r["cache_id"]))
        got = {r["probe_id"]: (r["similarity"], -r["cache_id"]) for r in retrieval.cache_probe(probes, cached.withColumnRenamed("c", "cached_embedding"), least).collect()}
        assert got == best and got


def test_a_block_keeps_what_can_be_among_the_best(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tallyglass.functions import nearest

    rows = np.random.default_rng(1).normal(size=(3000, 16))
    column = pa.array(rows.tolist())
    x, y = nearest.pair(column[:400], column)
    i, j, d = nearest.nearest(x, y, np.arange(400), np.arange(3000), 10)
    assert len(i) <= 400 * 12  # of 1.2 million pairs
    i, j, c = nearest.most_similar(x, y, np.arange(3000), 0.3)
    assert len(i) <= 400 * 2 and set(zip(range(400), range(400))) <= set(zip(i.tolist(), j.tolist()))
    # odd vectors, against the expression over all pairs
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 11)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 30)
    v = _odd_vectors(spark).select("vec_id", "embedding")
    q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    gap = F.round(F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, z: acc + z)), 9)
    pairs = q.crossJoin(v).filter("query_id <> vec_id").withColumn("d", gap)
    ranked = pairs.selectExpr("query_id", "vec_id", "d", "row_number() over (partition by query_id order by d, vec_id) - 1 as rank").filter("rank < 12")
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(retrieval.knn(q, v, 12, broadcast=3)) == plain(ranked)
