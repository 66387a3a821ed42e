"""Index versions, cache reuse, enriched contexts, functions in SQL."""

from __future__ import annotations

import random
import re
from collections import OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyglass import plans
from tallyglass.functions import folds, sqlfunctions, stats
from tallyglass.operators import decide, enrich, replay, reuse
from tallyglass.sources import indexes

SF = "/root/testdata/sf0.001"


# index versions


def _chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", f"d{i // 2}", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, text string")


def test_a_failed_build_leaves_the_index_that_was_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(indexes.IndexRefused, match="no finished index"):
        indexes.open_index(spark, root, "hash", 256)
    assert indexes.build(_chunks(spark, ["one two", "two three"]), root, "hash", 256, "v1") == 1
    first = indexes.open_index(spark, root, "hash", 256)
    with pytest.raises(indexes.IndexRefused, match="declares 128 components and made 256"):
        indexes.build(_chunks(spark, ["four"]), root, "hash", 128)
    with pytest.raises(indexes.IndexRefused, match="repeat"):
        indexes.build(_chunks(spark, ["a"]).unionByName(_chunks(spark, ["b"])), root, "hash", 256)
    monkeypatch.setattr(indexes.retrieval, "postings", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexes.build(_chunks(spark, ["five"]), root, "hash", 256)
    monkeypatch.undo()
    assert indexes.numbers(spark, root) == [1] and indexes.open_index(spark, root, "hash", 256) == first
    assert indexes.build(_chunks(spark, ["six seven", "eight", "nine"]), root, "hash", 256, "v2") == 2
    second = indexes.open_index(spark, root, "hash", 256)
    assert (second.number, second.chunks, second.corpus_version) == (2, 3, "v2")
    # a reader keeps what it has opened
    assert {r["text"] for r in first.all_chunks().collect()} == {"one two", "two three"} and {r["term"] for r in first.postings().collect()} == {"one", "two", "three"}
    for embedder, dim in (("hash", 64), ("other", 256)):
        with pytest.raises(indexes.IndexRefused, match="was made with hash of 256"):
            indexes.open_index(spark, root, embedder, dim)
    assert indexes.build(_chunks(spark, []), root, "hash", 256) == 3
    empty = indexes.open_index(spark, root, "hash", 256)
    assert empty.all_chunks().count() == empty.vectors().count() == empty.postings().count() == empty.get(["c1"]).count() == 0
    assert indexes.forget(spark, root, keep=2) == [1] and indexes.numbers(spark, root) == [2, 3]
    assert second.get(["c1"]).first()["text"] == "eight"


def test_point_reads_look_at_their_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "PER_BUCKET", 10)
    indexes.build(_chunks(spark, [f"text {i}" for i in range(95)]), str(tmp_path), "hash", 256)
    index = indexes.open_index(spark, str(tmp_path), "hash", 256)
    assert index.buckets == 10
    one = index.get(["c7"])
    assert [r["text"] for r in one.collect()] == ["text 7"] and len(one.inputFiles()) <= len(index.all_chunks().inputFiles())
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", one._jdf.queryExecution().toString())
    ids = spark.createDataFrame([("c3",), ("c90",), ("c3",), ("nothing",)], "chunk_id string")
    assert sorted(r["text"] for r in index.lookup(ids).collect()) == ["text 3", "text 90"]
    assert index.vectors().filter(F.size("embedding") == 256).count() == 95


# cache reuse


def test_hits_are_those_of_a_plain_cache(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 40)
    rng = random.Random(6)
    uses = [(1 if i % 9 else i % 5, i, None if rng.random() < 0.03 else f"e{int(rng.paretovariate(0.6)) % 50}") for i in range(1500)]
    df = spark.createDataFrame(uses, "scope long, at long, entry string").repartition(4)
    got = {r["at"]: r["depth"] for r in reuse.distances(df, ["scope"], ["at"], "entry", 32).collect()}
    assert len(got) == len(uses)
    caches = {c: defaultdict(OrderedDict) for c in (1, 2, 7, 32)}
    hits = defaultdict(int)
    for scope, at, entry in uses:
        for capacity, by_scope in caches.items():
            if entry is None:
                assert got[at] is None
                continue
            cache = by_scope[scope]
            hit = entry in cache
            assert (got[at] is not None and got[at] < capacity) == hit
            hits[scope, capacity] += hit
            cache[entry] = True
            cache.move_to_end(entry)
            if len(cache) > capacity:
                cache.popitem(last=False)
    rates = {(r["scope"], r["capacity"]): r["hits"] for r in reuse.hit_rates(reuse.distances(df, ["scope"], ["at"], "entry", 32), ["scope"], (1, 2, 7, 32)).collect()}
    assert rates == {(s, c): hits[s, c] for s in {u[0] for u in uses} for c in caches}


# enriched contexts


def _docs(spark, n=40):
    return spark.createDataFrame([(i, f"s{i % 5}" if i % 11 else None, "retrieved_untrusted" if i % 7 == 0 else "retrieved_verified") for i in range(n)], "doc_id long, domain string, provenance string")


def test_additions_are_safe_and_exact(spark):
    docs = _docs(spark)
    domain = {r["doc_id"]: r["domain"] for r in docs.collect()}
    safe = {r["doc_id"] for r in docs.collect() if r["provenance"] == "retrieved_verified" and r["domain"] is not None}
    levels = list(enrich.ADDED)
    items = [(i, levels[i % 3], domain.get(i % 40), [i % 40, (i * 7) % 40, (i * 7) % 40, 999]) for i in range(300)]
    df = spark.createDataFrame(items, "item_id long, level string, domain string, context array<long>")
    got = defaultdict(list)
    for r in enrich.additions(df, docs).orderBy("item_id", "draw").collect():
        got[r["item_id"]].append(r["doc_id"])
    for i, level, own, context in items:
        added = got.get(i, [])
        assert len(added) == len(set(added)) == enrich.ADDED[level]
        assert set(added) <= safe - set(context) and all(domain[d] != own for d in added)
    # every document that may be drawn is drawn for some item
    assert {d for ds in got.values() for d in ds} == safe
    assert {i: ds for i, ds in got.items()} == {r["item_id"]: list(r["ds"]) for r in enrich.additions(df.repartition(7), docs).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "doc_id"))), lambda x: x["doc_id"]).alias("ds")).collect()}
    with pytest.raises(Exception, match="too few safe documents"):
        enrich.additions(df.withColumn("level", F.lit("L3_conflict")), docs.filter("doc_id < 4")).collect()
    with pytest.raises(Exception, match="unknown level"):
        enrich.additions(df.withColumn("level", F.lit("L9")), docs).collect()
    assert enrich.additions(df.filter("false"), docs).count() == 0


def test_contradictions_check_their_direction(spark):
    docs = spark.createDataFrame([(1, "old", None), (2, " new. ", 1), (3, " ", 1)], "doc_id long, text string, contradicts long")
    items = lambda *rows: spark.createDataFrame(list(rows), "item_id long, source long, partner long")
    assert [tuple(r) for r in enrich.contradictions(items((9, 1, 2)), docs).collect()] == [(9, [1, 2], "new.", "new.")]
    for wrong, why in (((9, 2, 1), "direction"), ((9, 1, 3), "empty"), ((9, 1, 77), "direction")):
        with pytest.raises(Exception, match=why):
            enrich.contradictions(items(wrong), docs).collect()


# functions in SQL


def test_functions_in_sql_equal_those_over_columns(spark):
    rows = lambda name: sorted(tuple(r) for r in plans.QUERIES[name](spark, SF).collect())
    assert rows("sentences_in_sql") == rows("sentences") and rows("pii_in_sql") == rows("pii_spans")
    sqlfunctions.register(spark)
    counts = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (3, 17), (400, 1000)], "k long, n long")
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    both = spark.sql("SELECT k, n, wilson_lo(k, n) AS lo, wilson_hi(k, n) AS hi, hoeffding_p(k / n, n, 0.3D) AS p FROM {c} WHERE n > 0", c=counts)
    for r in both.withColumns({"low": low, "high": high, "q": stats.hoeffding(F.col("k") / F.col("n"), F.col("n"), 0.3)}).collect():
        assert r["lo"] == pytest.approx(r["low"], abs=1e-12) and r["hi"] == pytest.approx(r["high"], abs=1e-12) and r["p"] == pytest.approx(r["q"], abs=1e-12)
    assert spark.sql("SELECT wilson_lo(0, 0) + wilson_hi(0, 0)").first()[0] == 0
    nothing = spark.sql("SELECT s.* FROM {t} t, LATERAL sentences_of(t.text) s", t=spark.createDataFrame([(None,), ("",)], "text string"))
    assert nothing.count() == 0


# candidate policies


def test_a_replay_prices_as_the_engine_does(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0.0, 0.01, 0.05, 0.3, 0.9, None]), rng.choice([200.0, 5000.0, 90_000.0]), rng.choice(["reversible", "costly", "irreversible"]), rng.random() < 0.3) for i in range(120)]
    cases = spark.createDataFrame(rows, "case_id long, p double, impact_inr double, reversibility string, defective boolean").repartition(3)
    grid, seeds = [(0, 1.0, 0.0, 1.0), (5, 0.25, 0.03, 20.0), (9, 1.5, 0.015, 5.0)], [0, 4]
    weights = {(r["case_id"], s): r[f"w{s}"] for r in cases.select("case_id", *[replay.weight(F.col("case_id"), s).alias(f"w{s}") for s in seeds]).collect() for s in seeds}
    assert set(weights.values()) == {0, 1, 2}
    expected = {}
    whole = cases.filter("p is not null").withColumns({"probs": F.create_map(F.lit("ungrounded"), F.col("p")), "emitted": F.lit(False), "feasible_pass": F.lit(True)})
    for c, scale, band, nuisance in grid:
        adjustment = {"impact_scale": scale, "probability_deadband": band, "nuisance_multiplier": nuisance}
        chosen = decide.chosen(decide.options(whole, adjustment=adjustment), "case_id").join(cases, "case_id").collect()
        for s in seeds:
            of = [(weights[r["case_id"], s], r["action"], r["defective"]) for r in chosen]
            expected[c, s] = (
                sum(w for w, *_ in of), sum(w for w, a, d in of if a != "L0_pass" and not d), sum(w for w, a, d in of if a == "L0_pass" and d), sum(w for w, a, _ in of if a in ("L4_hold", "L5_block")),
            )
    results = replay.evaluated(cases, grid, seeds)
    got = {(r["candidate"], r["seed"]): (r["cases"], r["false_interventions"], r["escapes"], r["disruptive"]) for r in results.collect()}
    assert got == expected and len({v[1:] for v in got.values()}) > 2
    verdicts = {r["candidate"]: r["verdict"] for r in replay.compared(results, 0).collect()}
    assert set(verdicts) == {0, 5, 9} and "frontier" in verdicts.values()
    assert replay.evaluated(cases.filter("false"), grid, seeds).agg(F.sum("cases")).first()[0] in (None, 0)


def test_a_blocks_stack_meets_its_rows_once(spark, monkeypatch):
    """The stack that a block begins with was joined to each of its rows, which were shuffled and sorted with it."""
    monkeypatch.setattr(folds, "BLOCK", 4)
    uses = [(s, i, e) for s, entries in (("s", "abcdeabcdeedcbaxa"), (None, "aabbaabb")) for i, e in enumerate(entries)] + [("n", i, None) for i in range(9)]
    df = spark.createDataFrame(uses, "scope string, at long, entry string")
    out = reuse.distances(df, ["scope"], ["at"], "entry", 3)
    got = {(r["scope"], r["at"]): r["depth"] for r in out.collect()}

    def depth(scope, at, entry):
        mine = [e for s, i, e in uses if s == scope and i < at]
        if entry is None or entry not in mine:
            return None
        since = len(set(mine[len(mine) - mine[::-1].index(entry) :]))
        return since if since < 3 else None

    assert got == {(s, i): depth(s, i, e) for s, i, e in uses}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
