"""Votes of neighbours, whitening and spelling variants against brute force, on odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import common, neighbours, spelling, whitening

SF = "/root/testdata/sf0.01"


# spelling variants


def _near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _variants(rows, shortest=6, least=5, factor=5):
    total: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in total.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {w: min((-n[v], v) for v in vs)[1] for w, vs in near.items() if vs and max(n[v] for v in vs) >= factor * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def _spelling_rows():
    rng = random.Random(11)
    letters = "abé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    stems += ["a" * k for k in range(5, 10)] + ["b" * 400, "b" * 401, "Äpfelchen", "äpfelchen", "dividi÷ert", "aaabbb", "aabbb", "aaabb"]
    weights = [rng.choice([1, 1, 4, 30, 200]) for _ in stems]
    rows = []
    for i in range(400):
        words = rng.choices(stems, weights, k=rng.randint(0, 60))
        words = [w.upper() if w.isascii() and rng.random() < 0.1 else w for w in words]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "-", "1", "ļ", "ªµ"]) for w in words)))
    return [*rows, rows[5], rows[6], (7, rows[8][1]), (None, rows[9][1]), (900, None), (901, ""), (902, " .,"), (904, "kettena " * 6 + "kettenb " * 40 + "kettenbc " * 250), (903, "aaéabé " * 30_000)]


def test_spelling_variants_against_brute_force(spark, monkeypatch):
    rows = _spelling_rows()
    df = spark.createDataFrame([(i, t, 3, "q", "z") for i, t in rows], "doc_id long, text string, n int, word string, form string").repartition(3)
    got = {tuple(r) for r in spelling.variants(df).collect()}
    expected = _variants(rows)
    assert got == expected and any(f for _, f, *_ in expected) and any(f and r != f for _, f, r, *_ in expected)
    # many shards and rounds, and counts handed on early, change nothing
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 900)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert {tuple(r) for r in spelling.variants(df).collect()} == expected


def test_spelling_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0


def test_tries_and_automata():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab\xe9\xff") for _ in range(rng.randint(1, 9))).encode("latin-1") for _ in range(900)} | {b"a" * 300, b"a" * 301})
    n = [rng.randint(1, 4) for _ in words]
    trie = spelling.Trie(spelling._trie(words, n))
    assert [trie.spelled(k) for k in range(len(words))] == words and trie.counts.tolist() == n
    shards = [spelling._trie(words[a : a + 211], n[a : a + 211]) for a in range(0, len(words), 211)]
    asked = [*words, b"zz", b"abab\xe9\xe9"]
    near, most, forms = spelling._neighbours(asked, shards)
    for w, k, m, f in zip(asked, near.tolist(), most.tolist(), forms):
        by = [(-c, v) for v, c in zip(words, n) if _near(w.decode("latin-1"), v.decode("latin-1"))]
        assert (k, (-m, f)) == (len(by), min(by) if by else (0, None))


# whitening


def _whitened(x):
    """deviation, whitened and explained of integer vectors, by numpy's own decomposition; signs are free."""
    n = len(x)
    sums = x.sum(0)
    deviation = [int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))) for row in x]
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    with np.errstate(all="ignore"):
        return deviation, y @ axes / np.sqrt(values), values / values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 5)) * [9, 4, 1, 0.5, 0.2] @ rng.standard_normal((5, 5))).astype(np.float32)
    v[7] = v[8]
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    odd = [None, [], [1.0] * 5 + [2.0], [1.0, None, 1.0, 1.0, 1.0], [1.0, math.nan, 1.0, 1.0, 1.0], [math.inf] * 5, [0.5] * 4, [3e30] * 5]
    rows = [(i, e) for i, e in enumerate(v.tolist())] + [(5000 + i, e) for i, e in enumerate(odd)]
    df = spark.createDataFrame([(i, e, 1, "c", 2.0) for i, e in rows], "vec_id long, embedding array<float>, n int, component string, whitened double").repartition(4)
    got = whitening.whitened(df, most=4).toPandas()
    assert len(got) == 300 * 4 and set(got.vec_id) == set(range(300)) and set(got.component) == {1, 2, 3, 4} and set(got.n) == {300}
    deviation, reference, explained = _whitened(x)
    assert got[got.component == 1].set_index("vec_id").deviation.sort_index().tolist() == deviation
    w = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    signs = np.sign((w * reference[:, :4]).sum(0))
    assert np.abs(w - reference[:, :4] * signs).max() < 1e-9
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, explained[:4], rtol=1e-10)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-9
    again = whitening.whitened(df.repartition(1), most=4).toPandas().pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(w - again).max() < 1e-9  # the same signs as well


def test_whitening_of_too_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(frame(rows)).count() == 0
    # one direction of three has variance; a null key and repeated rows stay
    rows = [(1, [0.0, 5.0, 1.0]), (None, [1.0, 5.0, 1.0]), (3, [0.0, 5.0, 1.0]), (3, [0.0, 5.0, 1.0])]
    got = whitening.whitened(frame(rows)).toPandas()
    assert len(got) == 4 and set(got.component) == {1} and got.explained[0] == pytest.approx(1) and got.vec_id.isna().sum() == 1
    assert sorted(np.abs(got.whitened).round(6)) == [0.57735] * 3 + [1.732051]
    # what a long can't hold is null
    large = whitening.whitened(frame([(1, [2.0**45]), (2, [0.0])])).toPandas()
    assert large.deviation.isna().all() and np.allclose(np.abs(large.whitened), 1)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 16, 33):
        m = rng.standard_normal((n, n))
        scale = 10.0 ** np.linspace(0, -8, n)
        a = (m @ m.T + n * np.eye(n)) * scale[:, None] * scale
        values, axes = whitening.jacobi(a)
        assert (np.diff(values) <= 0).all() and np.abs(axes.T @ axes - np.eye(n)).max() < 1e-13
        # a graded matrix: the smallest eigenvalue from the inverse, where it is the largest
        inverse = np.linalg.inv((m @ m.T + n * np.eye(n))) / scale[:, None] / scale
        assert values[-1] == pytest.approx(1 / np.linalg.eigvalsh(inverse)[-1], rel=1e-9)
        assert np.abs(a @ axes - axes * values).max() < 1e-13 * max(1, values[0]) * 10
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_vector_sum(spark):
    def run(batches):
        total = np.zeros(1300, np.int64)
        for b in batches:
            total += np.arange(1300) * int(b.column(0).to_numpy().sum())
        yield from common.vector_parts(total)

    parts = spark.range(0, 5000, 1, 7).mapInArrow(run, common.PARTS)
    assert common.vector_sum(parts, 1300, np.int64).tolist() == [k * 4999 * 2500 for k in range(1300)]
    assert common.vector_sum(parts.filter("part < 0"), 3, np.float64).tolist() == [0, 0, 0]


# votes of neighbours


def _crc(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, neighbours.learn(docs, labels)


def test_held_out_labels_are_met(spark, learned):
    docs, labels, fit = learned
    rows = neighbours.scored(docs.withColumn("score", F.lit("x")), fit)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = rows.collect()
    assert len(rows) == docs.count() and all(r["held_out"] == _crc(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 60 and sum(p == q for p, q in held) >= 0.95 * len(held)
    assert sum(p for p, q in held if not q) <= 0.2 * sum(1 for _, q in held if not q)


def test_held_out_labels_and_other_columns_are_no_inputs(spark, learned):
    docs, labels, fit = learned
    turned = labels.withColumn("quality", F.when(neighbours.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(None).cast("int"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    score = lambda d, f: sorted((r["doc_id"], r["score"]) for r in neighbours.scored(d, f).collect())
    assert score(other, neighbours.learn(other, turned)) == score(docs, fit)
    moved = docs.select((F.col("doc_id") + 777).alias("doc_id"), "text")
    assert [s for _, s in score(moved, fit)] == [s for _, s in score(docs, fit)]


def test_votes_against_brute_force(learned, spark):
    """Terms, weights, cosines and votes, one text at a time and in plain Python, from the fit's own directions."""
    docs, _, fit = learned
    rows = docs.orderBy("doc_id").limit(25).collect()
    got = {r["doc_id"]: r["score"] for r in neighbours.scored(docs.filter(F.col("doc_id") <= rows[-1]["doc_id"]), fit).collect()}
    import pyarrow as pa

    for r in rows:
        row, term, times, n = neighbours._term_ids(pa.array([r["text"]]))
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        assert n.tolist() == [len(words)] and times[term < neighbours.WORDS].sum() == len(words)
        again = sum(a == b for a, b in zip(lower, lower[1:]))
        assert times[term == neighbours.WORDS + neighbours.SHAPES - 1].sum() == again
        shapes = {re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub(r"[a-z]|[^\x00-\x7f]", "a", w)))) for w, b in zip(words, [None, *lower]) if w.lower() != b}
        assert len(term[(term >= neighbours.WORDS) & (term < neighbours.WORDS + neighbours.SHAPES - 1)]) <= len(shapes)
        dense = np.zeros(neighbours.TERMS)
        neighbours._fill(dense, term, times, len(words), fit.idf)
        vector = dense @ fit.directions
        vector /= np.sqrt((vector**2).sum())
        cosines = sorted(((float(vector @ v), float(g)) for v, g in zip(fit.voters, fit.good)), reverse=True)
        near = [(max(c, 0) ** neighbours.POWER, g) for c, g in cosines[: neighbours.VOTERS]]
        tied = cosines[neighbours.VOTERS - 1][0] - cosines[neighbours.VOTERS][0] < 1e-9  # then either may vote
        assert tied or got[r["doc_id"]] == pytest.approx(sum(w * g for w, g in near) / sum(w for w, _ in near), abs=1e-6)


def test_fit_is_bounded_and_odd_rows_have_scores(spark, learned):
    docs, labels, _ = learned
    few = neighbours.learn(docs.unionByName(docs).unionByName(docs), labels, most=40)
    assert len(few.voters) == 40
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "a b c"), (None, "a b c"), (5, "w " * 200_000)], "doc_id long, text string")
    got = [(r["doc_id"], r["held_out"], r["score"]) for r in neighbours.scored(odd, few).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for *_, s in got) and len({s for i, _, s in got if i in (1, 2, 3)}) == 1
    assert all(h is False for i, h, _ in got if i is None)
    none = neighbours.learn(docs, labels.filter("false"))
    assert none is None and {r["score"] for r in neighbours.scored(odd, none).collect()} == {0.5}
    assert neighbours.learn(docs.filter("false"), labels) is None and neighbours.scored(docs.filter("false"), few).count() == 0
    repeated = labels.unionByName(labels).withColumn("score", F.lit(1))
    assert len(neighbours.learn(docs, repeated, most=10_000).voters) == labels.join(docs, "doc_id").filter(~neighbours.held_out("doc_id")).count()
