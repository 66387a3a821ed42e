"""Operators against brute force on small texts, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import common, html, lm, minhash, mixing, packing, repeats, rules, sharding, tokens, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=80, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        text = " ".join(words).replace(" a ", "\n", 2)
        if i % 5 == 0:
            text = f"{text}\t{passage} {text[:40]}"
        if i % 7 == 0 and out:
            text = out[-1][1]
        if i % 11 == 0 and out and out[-1][1]:
            changed = out[-1][1].split(" ")
            changed[len(changed) // 2] = "changed"
            text = " ".join(changed)
        out.append((i, text, "en", None if i % 9 == 0 else f"s{i % 4}", 0))
    out += [(n, None, None, "s1", None), (n + 1, "", "en", None, 0), (n + 2, " \t\n", "en", "s2", 3), (n + 3, "one", "en", "s3", 3)]
    out.append((n + 4, " ".join(rng.choice(vocabulary) for _ in range(20_000)), "en", "s0", 0))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows():
    import pyarrow as pa

    texts = ["ab  cd\x0b", None, "", "é x y", "\n"]
    data, offsets = tokens.text_buffer(pa.array(texts))
    starts, ends, first = tokens.word_spans(data, offsets)
    found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashed = tokens.hash_words(data, starts, ends)
    assert len(set(hashed.tolist())) == len(set(found))
    assert tokens.inside(first, 2).tolist() == [True, False, True]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_scratch_leaves_nothing(spark):
    from pathlib import Path

    staged = common.stage(spark.range(5))
    folder = Path(staged.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent.parent
    before = set(folder.iterdir())
    with common.scratch(spark):
        inner = common.stage(spark.range(7)).count()
    assert inner == 7 and set(folder.iterdir()) == before and staged.count() == 5


def test_main_text():
    page = """<body class="nav-open"><header>Site name.</header><nav><a href=/>Home</a></nav><main><article><h1>Title &amp; more</h1><p>First   text<br>goes on.
      <div class="ad">Buy it now, it is the best thing of all.</div><p>Second <b>bo</b>ld.</p><script>var x = "<p>no</p>";</script></article>
      <div id="comments"><p>What a great article, I liked it a lot.</p></div></main><aside>More of this, and of that too.</aside><footer>(c)</footer>"""
    assert html.main_text(page) == "Title & more\nFirst text goes on.\nSecond bold."
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("a < b") == "a < b"
    assert html.main_text("<p>" + "word " * 50_000).count("word") == 50_000


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        terminals = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        ties = {(a, b): rng.random() * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        cost = lambda side: sum((t if s else f) for (f, t), s in zip(terminals, side)) + sum(c for (a, b), c in ties.items() if side[a] != side[b])  # noqa: E731,B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.source_side(terminals, ties)) == pytest.approx(best)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x y.</p>", 5), (1, "u", "<p>x y.</p>", 5), (2, None, None, 6)], "page_id long, url string, html string, text int")
    got = html.extracted(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "x y.", 4), (1, "x y.", 4), (2, "", 0)]
    assert html.extracted(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = "<html><head><title>A&amp;B</title></head><body><a href='/x'>link</a><p>Ünï text</p></body></html>"
    pages = spark.createDataFrame([(1, "http://e.org/", page), (2, None, None)], "page_id long, url string, html string")
    made = warc.responses(pages)
    out = warc.derivatives(made).collect()
    assert Counter(r["record_type"] for r in out) == {"metadata": 2, "conversion": 2} and all(r["source_digest_ok"] for r in out)
    sources = {r["page_id"]: next(warc.parse(bytes(r["record"])))[0] for r in made.collect()}
    for r in out:
        headers, block, _ = next(warc.parse(bytes(r["record"])))
        assert headers["WARC-Refers-To"] == sources[r["page_id"]]["WARC-Record-ID"] == r["refers_to"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"] and int(headers["Content-Length"]) == len(block)
    text = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert next(warc.parse(bytes(text["record"])))[1].decode() == "link\nÜnï text"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(bytes(r["record"])) for r in made.collect()))
    again = warc.read_records(spark, str(tmp_path))
    assert sorted(r["record_id"] for r in warc.derivatives(again).collect()) == sorted(r["record_id"] for r in out)


def test_mixture(docs, empty):
    got = mixing.mixed(docs).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    source = {i: s for i, _, _, s, _ in rows()}
    totals = Counter()
    for i, n in sizes.items():
        totals[source[i]] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    share, fixed = dict(weight), {}
    while True:
        left = sum(totals.values()) - sum(fixed.values())
        over = [s for s in share if left * share[s] / sum(share.values()) > 3 * totals[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * totals[s]
            del share[s]
    target = fixed | {s: left * w / sum(share.values()) for s, w in share.items()}
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[source[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(sizes) and all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
    assert sorted(mixing.mixed(docs.repartition(5)).collect()) == sorted(got)
    words = mixing.mixed_texts(docs).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in words} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_mixed_texts_keep_rows_without_an_id_of_their_own(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    data = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, words(k, 10 + 3 * k), "en", f"s{k % 2}", 0) for k in range(60)]
    docs = spark.createDataFrame(data, SCHEMA)
    taken, got = Counter(), Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    texts = {tuple(t.split()) for _, t, *_ in data}
    known = {t[0]: t for t in texts} | {w: t for t in texts for w in t}
    for r in mixing.mixed_texts(docs).collect():
        found = r["text"].split()
        got[r["doc_id"]] += len(found)
        assert set(found) <= set(known[found[0]])
    assert got == {k: n for k, n in taken.items() if n}


def test_pipeline_keeps_different_texts_under_one_id(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    data = [(1, one), (2, two), (5, one), (5, three), (5, three), (6, ""), (6, ""), (6, None), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert Counter(got) == Counter([(1, one), (2, two), (5, three), (6, ""), (6, None), (None, two)])


def test_shard_draws_vary_as_without_putting_back():
    counts = np.array([5000, 2000, 900, 100], np.int64)
    share, whole = 2000, 8000
    draws = np.array([mixing._split(counts, share, whole, [7, i]) for i in range(4000)])
    assert (draws.sum(1) == share).all() and (draws >= 0).all() and (draws <= counts).all()
    p = counts / whole
    expected = share * p * (1 - p) * (whole - share) / (whole - 1)
    assert np.allclose(draws.mean(0), share * p, atol=4 * np.sqrt(expected / 4000)) and np.allclose(draws.var(0), expected, rtol=0.1)
    # the same law beyond what samplers without putting back can count
    huge = counts * 10**12
    draws = np.array([mixing._split(huge, share * 10**12, whole * 10**12, [8, i]) for i in range(500)])
    assert (draws.sum(1) == share * 10**12).all() and np.allclose(draws.var(0), expected * 10**12, rtol=0.25)


def test_mixture_of_repeated_rows_and_clashing_columns(spark):
    data = [(1, "a b c d", "s", 4)] * 50 + [(None, "e f g", None, 4)] * 40 + [(2, None, "t", 4), (3, "", "t", 4), (1, "x " * 90, "s", 4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, parts int").withColumns({"whole": F.lit(1), "start": F.lit(2), "uses": F.lit(3), "rank": F.lit(4)})
    got = mixing.mixed(df, block=8).collect()
    assert len(got) == len(data) and all(r["taken"] <= 3 * r["size"] for r in got)
    for source_size in {r["source_size"] for r in got}:
        of = [r for r in got if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 8
    again = mixing.mixed(df.repartition(5, "text"), block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = mixing.mixed_texts(df, block=8)
    assert texts.columns == df.columns
    words = Counter(w for r in texts.collect() for w in WORD.findall(r["text"]))
    assert sum(words.values()) == sum(r["taken"] for r in got)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing._permuted(np.arange(n), n, 5).tolist()) == list(range(n))


@pytest.mark.parametrize("order", [3, 5])
def test_scores(spark, docs, empty, order):
    got = {r["doc_id"]: r for r in lm.scored(docs, order).collect()}
    texts = {i: t or "" for i, t, *_ in rows()}
    lowered = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in texts.items()}
    train = {i for i in lowered if zlib.crc32(str(i).encode()) % 7 != 2}
    tokens_of = {i: [*WORD.findall(t), None] for i, t in lowered.items()}
    counts = Counter(w for i in train for w in tokens_of[i])
    total, kinds = sum(counts.values()), len(counts)
    trie = defaultdict(Counter)

    def coded(t):
        """Contexts and symbols of each byte and the end."""
        data = b"\xff" * order + t.encode() + b"\xff"
        return [(data[k - order : k], data[k]) for k in range(order, len(data))]

    for i in train:
        for context, symbol in coded(texts[i]):
            trie[context][symbol] += 1
    for k in range(order, 0, -1):
        for context, symbols in [x for x in trie.items() if len(x[0]) == k]:
            for symbol in symbols:
                trie[context[1:]][symbol] += 1

    def log_p(context, symbol):
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            seen = {s: c for s, c in trie[context[len(context) - k :]].items() if s not in gone}
            if not seen:
                continue
            mass = sum(seen.values())
            if symbol in seen:
                return out + math.log10((seen[symbol] - lm.DISCOUNT) / mass)
            out += math.log10(len(seen) * lm.DISCOUNT / mass)
            gone |= set(seen)
        return out - math.log10(max(1, 256 - len(gone)))

    for i, t in texts.items():
        r = got[i]
        assert r["held_out"] == (i not in train) and r["train_tokens"] == total and r["n_tokens"] == len(tokens_of[i]) and r["n_known"] == sum(w in counts for w in tokens_of[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens_of[i]))
        assert r["score"] == pytest.approx(sum(log_p(c, x) for c, x in coded(t)), rel=1e-11) and r["n_bytes"] == len(t.encode())
    assert sum(10 ** log_p(b" ab" + b"c" * (order - 3), s) for s in range(256)) == pytest.approx(1)
    assert lm.scored(empty).count() == 0


def test_chunks_of_a_stream_see_what_lies_before_them(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["", "a", "", *["".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) for _ in range(30)], ""]
    rows_ = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "train": [True] * len(texts)})
    for order in (3, 5):
        expected = []
        for t in texts:
            data = b"\xff" * order + t.encode() + b"\xff"
            expected.append([int.from_bytes(data[k - order : k + 1], "big") for k in range(order, len(data))])
        for size in (1, 7, 64, 1 << 20):
            monkeypatch.setattr(lm, "SLICE_BYTES", size)
            got = [[] for _ in texts]
            for keys, of_text in lm._Stream(rows_, order).chunks():
                for i, k in zip(np.repeat(np.arange(len(texts)), of_text).tolist(), keys.tolist(), strict=True):
                    got[i].append(k)
            assert got == expected


def test_scores_of_odd_rows(spark):
    """Repeated rows and rows without an id train and are scored each; case and white space count."""
    some = [(1, "A b  c", 9), (1, "A b  c", 9), (None, "a b c", 9), (None, None, 9), (2, "a b c", 9), (3, "\u00ff\U0001F600", 9)]
    got = lm.scored(spark.createDataFrame(some, "doc_id long, text string, score int"), 3).collect()
    assert len(got) == len(some) and Counter(r["doc_id"] for r in got) == {1: 2, None: 2, 2: 1, 3: 1}
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and {r["n_bytes"] for r in got if r["doc_id"] is None} == {0, 5}
    assert len({r["base_score"] for r in got if r["n_tokens"] == 4}) == 1 and len({r["score"] for r in got if r["n_tokens"] == 4}) == 2
    with pytest.raises(ValueError):
        lm.scored(spark.createDataFrame(some, "doc_id long, text string, score int"), 2)


def test_packing(docs, empty):
    got = packing.packed(docs, capacity=300, per_source=2, with_text=True).collect()
    size, bins = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}, defaultdict(list)
    texts = {i: WORD.findall(t or "") for i, t, *_ in rows()}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        assert (r["bin_id"] is None) == (size[r["doc_id"]] == 0)
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert sum(r["n_words"] for r in pieces) == size[i] and [w for r in pieces for w in WORD.findall(r["text"])] == texts[i]
    for pieces in bins.values():
        assert sum(r["n_words"] for r in pieces) <= 300 and max(Counter(r["source"] for r in pieces).values()) <= 2
        assert max(Counter(r["text"] for r in pieces).values()) == 1 and sorted(r["position"] for r in pieces) == list(range(len(pieces)))
    assert set(by_doc) == set(size) and packing.packed(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.pack_group([6, 5, 4, 4], [0, 1, 2, 0], [-1, -1, -1, -1], 10, 1) == [0, 1, 0, 1]
    assert packing.pack_group([5, 5, 5], [0, 1, 2], [0, 0, -1], 10, 3) == [0, 1, 0]


def test_best_fit_against_every_bin():
    rng = random.Random(11)
    for _ in range(60):
        n, capacity, per_source = rng.randint(1, 60), rng.randint(5, 40), rng.randint(1, 3)
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        sources, clusters = [rng.randint(0, 4) for _ in range(n)], [rng.choice((-1, 0, 1, 2)) for _ in range(n)]
        bins, chosen = [], []
        for size, source, cluster in zip(sizes, sources, clusters):
            fits = [
                (capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
                if capacity - sum(x[0] for x in b) >= size and sum(x[1] == source for x in b) < per_source and (cluster < 0 or all(x[2] != cluster for x in b))
            ]
            i = min(fits)[1] if fits else len(bins)
            bins.extend([[]] if i == len(bins) else [])
            bins[i].append((size, source, cluster))
            chosen.append(i)
        assert packing.pack_group(sizes, sources, clusters, capacity, per_source) == chosen


def test_packing_keeps_clusters_and_repeated_rows_apart(spark):
    some = [(7, "a b c", "s", 1)] * 30 + [(None, "a b c", "s", 1)] * 30 + [(i, f"w{i} x", f"s{i}", 2) for i in range(100, 140)]
    docs = spark.createDataFrame(some, "doc_id long, text string, source string, piece int")
    clusters = spark.createDataFrame([(7, 7)] + [(i, 100 + i % 2) for i in range(100, 140)], "doc_id long, component_id long")
    got = packing.packed(docs, capacity=50, per_source=2, clusters=clusters).collect()
    assert len(got) == 100 and all(r["bin_id"] is not None for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        ids = [r["doc_id"] for r in b]
        assert ids.count(7) <= 1 and ids.count(None) <= 1 and all(sum(i is not None and i >= 100 and i % 2 == k for i in ids) <= 1 for k in (0, 1))
    by_column = packing.packed(docs, capacity=50, per_source=9, cluster=F.col("piece")).collect()
    assert len({r["bin_id"] for r in by_column}) == 60


def _near(text_rows, percent=85, width=5):
    sets = {}
    for i, t, *_ in text_rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == _near(rows())
    # a family around texts that link to neighbours only, so that buckets keep several components
    rng, base, family = random.Random(5), [f"w{k}" for k in range(160)], []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(160), 1 + i % 6):
            copy[k] = f"x{i}_{k}"
        family.append((i, " ".join(copy), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(family, SCHEMA)).collect()}
    assert got == _near(family)
    twice = docs.unionByName(docs.filter("doc_id < 3")).withColumn("bands", F.lit(1)).withColumn("rep", F.lit("x"))
    assert minhash.near_duplicates(twice).count() == docs.count() + 3 and minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_odd_ids(spark):
    """Different texts under one id are compared each, and rows without an id take part."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = lambda t: t.replace("30", "x")
    data = [(5, a), (5, b), (7, near(a)), (9, near(b)), (None, a), (None, near(b)), (None, c), (None, c), (3, near(c)), (1, None), (1, ""), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), percent=80).collect()
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert found == Counter({(5, 5, True): 2, (7, 5, False): 1, (9, 5, False): 1, (None, 5, False): 2, (None, 3, False): 2, (3, 3, True): 1, (1, 1, True): 2, (None, None, True): 1})
    alone = minhash.near_duplicates(spark.createDataFrame([(None, c), (None, near(c)), (2, a)], "doc_id long, text string"), percent=80).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in alone) == Counter({(None, None, True): 2, (2, 2, True): 1})


def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch):
    """Many families in the same buckets, in blocks so small that each bucket is cut into many."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng, base, family = random.Random(8), [f"w{k}" for k in range(120)], []
    for f in range(12):
        own = base[: 120 - 8] + [f"f{f}_{k}" for k in range(8)] if f % 2 else base[8:] + [f"f{f}_{k}" for k in range(8)]
        for i in range(9):
            copy = list(own)
            for k in rng.sample(range(120), i % 5):
                copy[k] = f"x{f}_{i}_{k}"
            family.append((100 * f + i, " ".join(copy), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(family, SCHEMA)).collect()}
    assert got == _near(family) and len({c for _, c in got.values()}) > 2


def test_quality_counts(docs, empty):
    for r in rules.judged(docs.withColumn("n_words", F.lit("clash")), []).collect():
        text = r["text"] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == sum(map(text.count, "#*$%&|<>")) and r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])
    assert rules.judged(empty, []).count() == 0


def test_decision_list(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append((i, " ".join((f"w{rng.randint(0, 500)}" + ("#$%" if bad else "")) for _ in range(80)) + (" a & b" if i % 6 == 1 else ""), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    docs, given = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = rules.learn(docs, given)
    got = {r["doc_id"]: r["kept"] for r in rules.judged(docs, learned).collect()}
    assert learned and got == {i: q == 1 for i, q, _ in labels}
    assert rules.learn(docs, given.limit(0)) == [] and rules.learn(docs, given.filter("quality = 1")) == []


def _without(text_rows, width=20):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in text_rows}
    gone = defaultdict(set)
    for i in sorted(words):
        for at in range(len(words[i]) - width + 1):
            if first.setdefault(tuple(words[i][at : at + width]), (i, at)) != (i, at):
                gone[i] |= set(range(at, at + width))
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


def test_repeated_passages(spark, docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.without_repeats(docs).collect()}
    assert got == _without(rows())
    for shift in range(15):  # passages at every distance of their starts modulo the period
        text = [f"u{k}" for k in range(22)]
        pair = [(1, " ".join(["a"] * shift + text + ["b"]), "en", "s", 0), (2, " ".join(["c", *text]), "en", "s", 0)]
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.without_repeats(spark.createDataFrame(pair, SCHEMA)).collect()}
        assert got == _without(pair)
    assert repeats.without_repeats(empty).count() == 0
    # first hashes of 3 bits: almost all windows collide, and only the second hash tells them apart
    weak = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.without_repeats(docs, bits=3).collect()}
    assert weak == _without(rows())
    nameless = repeats.without_repeats(docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long"))))
    assert {r["n_removed"] for r in nameless.filter("doc_id is null").collect()} == {0}
    assert {r["doc_id"]: r["n_removed"] for r in nameless.filter("doc_id is not null").collect()} == {i: v[1] for i, v in _without(rows()).items()}
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("more", F.array(F.lit(1)))
    assert repeats.without_repeats(clash.unionByName(clash.filter("doc_id = 5")), join_words=False).count() == docs.count() + 1


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 16))
    data = [(i, (centers[i % 6] + rng.normal(size=16) * (0.1 if i % 3 else 0.5)).astype(float).tolist()) for i in range(300)]
    data += [(300, data[0][1]), (301, [2 * v for v in data[0][1]]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [None] + [1.0] * 15), (306, []), (307, [1.0, 2.0]), (307, [1.0, 2.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    x = np.array([v for _, v in data[:302]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    label = np.arange(len(x))
    while (new := np.array([label[near[i]].min() for i in range(len(x))])).tolist() != label.tolist():
        label = new
    expected = [(i, int(near[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(x))]
    expected += [(i, 0, i, True) for i in range(302, 307)] + [(307, 1, 307, True)] * 2
    assert got == sorted(expected)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def _pairs_at(n, pairs, seed, dims=32, cosine=0.9001):
    """n vectors in random directions, and as many as ``pairs`` of them with one more vector at the cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.normal(size=(pairs, dims))
    aside -= (aside * x[:pairs]).sum(1)[:, None] * x[:pairs]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    return np.vstack([x, cosine * x[:pairs] + math.sqrt(1 - cosine**2) * aside])


def _link_counts(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return np.array([r["n_links"] for r in vectors.near_vectors(df).sort("vec_id").collect()])


def test_rare_links_are_all_found(spark):
    x = _pairs_at(3000, 110, 2, dims=16)
    assert _link_counts(spark, x).tolist() == ((x @ x.T >= 0.9).sum(1) - 1).tolist()


def test_many_lengths_and_clashing_columns(spark):
    """Pairs of almost parallel vectors of 70 lengths, with columns named like those that the operator adds."""
    rng, data = np.random.default_rng(6), []
    for w in range(1, 71):
        v = rng.normal(size=w)
        data += [(2 * w, v.tolist(), 1), (2 * w + 1, (v * 3 + 1e-3 * rng.normal(size=w)).tolist(), 1)]
    data += [(i, rng.normal(size=33).tolist(), 1) for i in range(1000, 1100)] + [(None, [1.0] * 33, 1), (None, [1.0] * 33, 1)]
    df = spark.createDataFrame([(*d, "x", 2, 3) for d in data], "vec_id long, embedding array<double>, size long, unit string, rep long, cell int")
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(data) and all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] is None)
    by_length = defaultdict(list)
    for i, v, _ in data:
        if i is not None:
            by_length[len(v)].append((i, np.array(v)))
    expected = {}
    for members in by_length.values():
        ids, x = [i for i, _ in members], np.array([v / np.linalg.norm(v) for _, v in members])
        expected |= dict(zip(ids, ((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None} == expected


def test_recall_where_the_bound_is_measured(spark):
    """More groups than the bound needs, some at the threshold itself: at least 0.9 of all links, and none that isn't one."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(600, 24))
    noise = rng.uniform(0.02, 0.4, size=600)
    x = np.vstack([c + n * rng.normal(size=(5, 24)) for c, n in zip(centers, noise)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, true = _link_counts(spark, x), (x @ x.T >= 0.9).sum(1) - 1
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum()


def test_links_count_for_both_ends(spark):
    # so many copies that the bound can be measured, and pairs that only one end's query may find
    x = _pairs_at(3000, 1200, 4, cosine=0.99)
    x = np.vstack([x, _pairs_at(300, 300, 5)])
    got = _link_counts(spark, x)
    assert (got[4200:4500] == got[4500:]).all() and got[4200:].sum() > 0 and (got <= (x @ x.T >= 0.9).sum(1) - 1).all()


def test_shards(spark, docs, empty):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, "the same", "en", "s", 0) for i in range(30)], SCHEMA))
    got = sharding.sharded(many, 4).collect()
    texts = {i: t for i, t, *_ in rows()}
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) + 30 and max(sizes.values()) - min(sizes.values()) <= 1 and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    for r in got:
        raw = (texts.get(r["doc_id"], "the same") or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    groups = defaultdict(list)
    for r in got:
        groups[texts.get(r["doc_id"], "the same")].append(r["shard"])
    split = [g for t, g in groups.items() if len(g) > 1 and len(set(g)) > 1]
    assert len(split) <= 1
    assert sharding.sharded(empty).count() == 0


def _split_groups(got, text_of):
    groups = defaultdict(list)
    for r in got:
        groups[text_of(r["doc_id"])].append(r["shard"])
    return sum(len(set(g)) > 1 for g in groups.values())


def test_groups_that_fill_the_shards_stay_whole(spark):
    """Nothing but groups of equal texts, ten of which fit each shard exactly."""
    df = spark.range(0, 80 * 50).select(F.col("id").alias("doc_id"), (F.col("id") % 80).cast("string").alias("text"))
    got = sharding.sharded(df).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {500} and _split_groups(got, lambda i: i % 80) == 0


def test_shards_of_uneven_groups_against_the_fewest_splits(spark):
    """A group of a third of all rows must be cut, into as few parts as can be; no other needs to be."""
    data = [(i, "big" if i % 3 == 0 else f"t{i % 97}" if i % 3 == 1 else f"u{i}") for i in range(3000)]
    texts = dict(data)
    got = sharding.sharded(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {375} and _split_groups(got, texts.get) == 1
    assert len({r["shard"] for r in got if texts[r["doc_id"]] == "big"}) == 3


def test_shards_do_not_depend_on_partitions(spark):
    """Null and repeated ids, equal and different texts, clashing columns: the same rows however they come."""
    data = [(None, f"t{i % 40}", 1) for i in range(120)] + [(5, "same", 1)] * 200 + [(5, None, 1)] * 7 + [(i, f"t{i}", 1) for i in range(200, 260)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard int").withColumn("link", F.lit("x")).withColumn("at", F.lit(1))
    runs = [sorted(map(tuple, sharding.sharded(d).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str) for d in (df, df.orderBy(F.desc("text")).repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(data)


def test_offsets_over_many_groups(spark):
    df = spark.range(0, 6000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("i"), (F.col("id") % 5).alias("v"))
    for group in (1, 2, 6000):
        by = defaultdict(list)
        for r in common.offsets(df, ["k"], ["i", "v"], "v", "s", 6000, group).collect():
            by[r["k"]].append((r["s"], r["v"]))
        for pairs in by.values():
            at = 0
            for s, v in sorted(pairs):
                assert s == at
                at += v
            assert len(pairs) == 2000


def test_digest_of_kept_words(spark):
    docs = spark.createDataFrame([(1, " a\tb ", "en", "s", 0)], SCHEMA)
    row = repeats.without_repeats(docs).select(F.sha2("text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"a b").hexdigest()


def test_near_copies_of_one_text_cost_a_linear_number_of_comparisons(spark, monkeypatch):
    """Copies that each differ in two of 120 words: few are similar to each other, and the leaders find nearly all that are."""
    compared, verified = [], minhash._verified

    def counting(pairs, sets, percent):
        compared.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_verified", counting)
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]

    def family(m):
        out = []
        for i in range(m):
            changed = list(base)
            for at in rng.sample(range(120), 2 if i != 7 else 0):
                changed[at] = rng.choice(vocabulary)
            out.append((i, " ".join(changed)))
        return out

    counts = {}
    for m in (100, 400):
        compared.clear()
        texts = family(m)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        if m == 100:
            assert got == _near(texts)
        counts[m] = sum(compared)
    assert counts[400] <= 5 * counts[100]


def test_labels_move_towards_neighbours_round_by_round(spark):
    """Cuts fall, quotas hold after every round, and what is whole stays whole; against a plain recount."""
    rng = random.Random(12)
    sizes = [rng.choice([2, 2, 3, 5, 9, 20]) for _ in range(120)]
    rows = [(f"g{g}", rng.randrange(4)) for g, size in enumerate(sizes) for _ in range(size)]
    labels = spark.createDataFrame([(link, shard, n) for (link, shard), n in Counter(rows).items()], "link string, shard int, n long")
    held = Counter(shard for _, shard in rows)
    quota = [max(held.values()) + extra for extra in (0, 3, 0, 7)]
    plain = lambda of: sum((sum(v.values()) ** 2 - sum(x * x for x in v.values())) // 2 for v in of.values())
    before = defaultdict(Counter)
    for link, shard in rows:
        before[link][shard] += 1
    after, free, cuts = sharding.propagated(labels, [q - held[s] for s, q in enumerate(quota)])
    got = defaultdict(Counter)
    for r in after.collect():
        got[r["link"]][r["shard"]] += r["n"]
    assert {k: sum(v.values()) for k, v in got.items()} == {k: sum(v.values()) for k, v in before.items()}
    now = Counter()
    for v in got.values():
        now.update(v)
    assert free == [q - now[s] for s, q in enumerate(quota)] and min(free) >= 0
    assert cuts[0] == plain(before) and cuts[-1] == plain(got) and cuts == sorted(cuts, reverse=True) and len(cuts) > 1
    assert sum(len(v) > 1 for v in got.values()) <= 3
    # nobody left could go anywhere whole
    assert all(all(sum(v.values()) - v[s] > free[s] for s in range(4)) for v in got.values() if len(v) > 1)
