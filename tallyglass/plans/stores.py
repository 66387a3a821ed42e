"""Registered queries over index versions, cache reuse, enriched contexts, and functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import policy, storage, views
from tallyglass.functions import sqlfunctions
from tallyglass.operators import decide, enrich, replay, reuse
from tallyglass.plans.ledger import _ACTIONS, _GRID
from tallyglass.sources import indexes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# -- indexes -------------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> str:
    """The documents as an index in its second version; the first held their sources only."""
    root = f"{storage.shared_folder(spark)}/indexes-{uuid.uuid4().hex}"
    d = views.fragments(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))
    indexes.build(d.withColumn("text", F.coalesce("domain", F.lit(""))), root, "hash", 256, "sources")
    indexes.build(d, root, "hash", 256, "texts")
    return root


@query(r"""WITH t AS (SELECT doc_id, count(*) AS terms FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM documents) GROUP BY 1)
    SELECT d.doc_id::VARCHAR AS chunk_id, source AS domain, md5(text) AS text_md5, coalesce(t.terms, 0)::BIGINT AS terms, 256 AS width
    FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.doc_id % 100 = 0""")
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a version by their ids, every hundredth of them, with what its postings and vectors have on them."""
    index = indexes.open_index(spark, _index(spark, sf_dir), "hash", 256)
    asked = views.table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("chunk_id"))
    terms = index.postings().groupBy("chunk_id").agg(F.count("*").alias("terms"))
    widths = index.vectors().select("chunk_id", F.size("embedding").alias("width"))
    found = index.lookup(asked).join(terms, "chunk_id", "left").join(widths, "chunk_id")
    return found.select("chunk_id", "domain", F.md5("text").alias("text_md5"), F.coalesce("terms", F.lit(0)).alias("terms"), "width")


@query("""SELECT t.embedder, t.dim, t.version, t.refused, CASE WHEN NOT refused THEN n.n END AS chunks FROM (VALUES ('hash', 256, 2, false), ('hash', 128, 2, true), ('other', 256, 2, true), ('hash', 256, 1, false), ('hash', 256, 9, true)) AS t(embedder, dim, version, refused),
    (SELECT count(*) AS n FROM documents) n""")
def index_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which openings of an index are refused before any read, and what the others hold."""
    root, out = _index(spark, sf_dir), []
    for embedder, dim, version in (("hash", 256, 2), ("hash", 128, 2), ("other", 256, 2), ("hash", 256, 1), ("hash", 256, 9)):
        try:
            out.append((embedder, dim, version, False, indexes.open_index(spark, root, embedder, dim, version).all_chunks().count()))
        except indexes.IndexRefused:
            out.append((embedder, dim, version, True, None))
    return spark.createDataFrame(out, "embedder string, dim int, version int, refused boolean, chunks long")


# -- cache reuse ---------------------------------------------------------------------------------------------------------

_CAPACITIES = (4, 16, 32, 64)


@query(f"""WITH u AS (SELECT user_id % 5 AS tenant, event_id, json_extract_string(props, '$.k') AS entry FROM events),
    p AS (SELECT *, lag(event_id) OVER (PARTITION BY tenant, entry ORDER BY event_id) AS was FROM u),
    d AS (SELECT p.tenant, p.event_id, count(DISTINCT o.entry) AS depth FROM p LEFT JOIN u o ON o.tenant = p.tenant AND o.event_id > p.was AND o.event_id < p.event_id WHERE p.was IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT tenant, count(*) AS uses FROM u GROUP BY 1)
    SELECT n.tenant, c.capacity, n.uses, (SELECT count(*) FROM d WHERE d.tenant = n.tenant AND d.depth < c.capacity)::BIGINT AS hits FROM n, (VALUES {', '.join(f'({c})' for c in _CAPACITIES)}) AS c(capacity)""")
def context_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a context cache for several capacities, from one pass over the uses of each tenant."""
    e = views.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("tenant"), "event_id", F.get_json_object("props", "$.k").alias("entry"))
    return reuse.hit_rates(reuse.distances(e, ["tenant"], ["event_id"], "entry", 64), ["tenant"], _CAPACITIES)


# -- enriched contexts ---------------------------------------------------------------------------------------------------

_LEVEL = ("L1_direct", "L2_distractor", "L3_conflict")


@query("""WITH pool AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents WHERE doc_id % 20 <> 0 AND source IS NOT NULL),
    n AS (SELECT count(*) AS n FROM pool), own AS (SELECT source, min(place) AS start, count(*) AS size FROM pool GROUP BY 1),
    i AS (SELECT d.doc_id AS item_id, d.source, length(d.text) % 3 AS wanted FROM documents d WHERE length(d.text) % 3 > 0),
    h AS (SELECT i.item_id, p.place AS start, 1::BIGINT AS size FROM i JOIN pool p ON p.doc_id IN (i.item_id, i.item_id - 1) AND p.source IS DISTINCT FROM i.source
        UNION ALL SELECT i.item_id, own.start, own.size FROM i JOIN own ON own.source = i.source),
    g AS (SELECT i.item_id, i.wanted, coalesce(list([h.start, h.size] ORDER BY h.start) FILTER (h.start IS NOT NULL), []) AS gaps, n.n - coalesce(sum(h.size), 0) AS rest FROM n, i LEFT JOIN h ON h.item_id = i.item_id GROUP BY i.item_id, i.wanted, n.n),
    a AS (SELECT *, list_reduce(list_prepend([('0x' || md5('7|' || item_id || '|1')[:12])::BIGINT % rest::BIGINT, 0], gaps), lambda x, y: CASE WHEN y[1] <= x[1] THEN [x[1] + y[2], 0] ELSE x END)[1] AS p1 FROM g),
    b AS (SELECT *, CASE WHEN wanted > 1 THEN list_reduce(list_prepend([('0x' || md5('7|' || item_id || '|2')[:12])::BIGINT % (rest::BIGINT - 1), 0], list_sort(list_append(gaps, [p1, 1]))), lambda x, y: CASE WHEN y[1] <= x[1] THEN [x[1] + y[2], 0] ELSE x END)[1] END AS p2 FROM a)
    SELECT b.item_id, 1 AS draw, pool.doc_id FROM b JOIN pool ON pool.place = b.p1 UNION ALL SELECT b.item_id, 2, pool.doc_id FROM b JOIN pool ON pool.place = b.p2""")
def enriched_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item whose context holds it and the one before; its level follows from its length."""
    docs = views.fragments(spark, sf_dir)
    level = views.pick(_LEVEL, F.length("text") % 3)
    items = docs.select(F.col("doc_id").alias("item_id"), level.alias("level"), "domain", F.array("doc_id", F.col("doc_id") - 1).alias("context"))
    return enrich.additions(items, docs, seed=7)


@query("""SELECT a.doc_id AS item_id, b.doc_id AS partner, md5(trim(b.text)) AS answer_md5 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE trim(b.text) <> ''""")
def contradiction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose answer follows the document that contradicts theirs: here each contradicts the one before it."""
    docs = views.fragments(spark, sf_dir).withColumn("contradicts", F.col("doc_id") - 1)
    held = docs.filter("trim(text) <> ''").select(F.col("contradicts").alias("source"), F.col("doc_id").alias("partner"))
    items = docs.select(F.col("doc_id").alias("source")).join(held, "source").select(F.col("source").alias("item_id"), "source", "partner")
    made = enrich.contradictions(items, docs)
    return made.select("item_id", F.get("context", F.lit(1)).alias("partner"), F.md5("answer").alias("answer_md5"))


# -- candidate policies --------------------------------------------------------------------------------------------------

_SEEDS, _SHIPPED = (0, 1, 2), 108
_REPLAY = f"""{_GRID}, v_case AS (SELECT doc_id, p, y = 1 AS defective, d.impact, CASE d.rev WHEN 'reversible' THEN 1.0 WHEN 'costly' THEN 2.5 ELSE 8.0 END::DOUBLE AS rev
        FROM v_scored s JOIN (VALUES {", ".join(f"({i}, {impact}::DOUBLE, '{rev}')" for i, (impact, rev) in enumerate(policy.POLICY["domains"].values()))}) AS d(i, impact, rev) ON d.i = s.doc_id % {len(policy.POLICY["domains"])}),
    v_loss AS (SELECT candidate, doc_id, defective, action, ladder, round(greatest(0, p - band) * impact * scale * rev * (1 - e0) + (1 - greatest(0, p - band)) * nuis * nuisance
        + tok * {policy.POLICY["price_inr_per_1k_tokens"]}::DOUBLE / 1000 + rv + {policy.POLICY["lambda_time_inr_per_second"]}::DOUBLE * lat / 1000, 6) AS total FROM v_case, v_grid, (VALUES {_ACTIONS}) AS a(action, ladder, nuis, tok, lat, rv, e0, e1, e2)),
    v_best AS (SELECT candidate, doc_id, any_value(defective) AS defective, arg_min(ladder, total * 10 + ladder / 1e7) AS ladder FROM v_loss GROUP BY 1, 2),
    v_replay AS (SELECT candidate, t.seed::INT AS seed, sum(w)::BIGINT AS cases, sum(CASE WHEN ladder > 0 AND NOT defective THEN w ELSE 0 END)::BIGINT AS false_interventions,
        sum(CASE WHEN ladder = 0 AND defective THEN w ELSE 0 END)::BIGINT AS escapes, sum(CASE WHEN ladder >= 4 THEN w ELSE 0 END)::BIGINT AS disruptive
        FROM (SELECT *, ('0x' || md5(seed || '|' || doc_id)[:8])::BIGINT % 3 AS w FROM v_best, (VALUES {", ".join(f"({s})" for s in _SEEDS)}) AS s(seed)) t GROUP BY 1, 2)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the grid over all labelled documents, whose domains give what is at stake, in three seeds' sets."""
    grid = [(r["candidate"], r["impact_scale"], r["deadband"], r["nuisance_multiplier"]) for r in decide.candidate_grid(spark).collect()]
    stakes = list(policy.POLICY["domains"].values())
    at = F.col("doc_id") % len(stakes)
    cases = views.scored(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "p", (F.col("y") == 1).alias("defective"), views.pick([i for i, _ in stakes], at).cast("double").alias("impact_inr"), views.pick([r for _, r in stakes], at).alias("reversibility"))
    return replay.evaluated(cases, grid, list(_SEEDS))


@query(views.sql(f"WITH {_REPLAY} SELECT * FROM v_replay", "v_scored"))
def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)


@query(views.sql(f"""WITH {_REPLAY}, w AS (SELECT candidate, count(*) AS seeds, max(false_interventions) AS worst_false_interventions, max(escapes) AS worst_escapes, max(disruptive) AS worst_disruptive FROM v_replay GROUP BY 1),
    g AS (SELECT w.*, w.worst_escapes <= b.worst_escapes AS open FROM w, (SELECT worst_escapes FROM w WHERE candidate = {_SHIPPED}) b)
    SELECT candidate, seeds, worst_false_interventions, worst_escapes, worst_disruptive, CASE WHEN NOT open THEN 'more escapes than shipped' WHEN EXISTS (SELECT 1 FROM g y WHERE y.open
        AND y.worst_false_interventions <= x.worst_false_interventions AND y.worst_escapes <= x.worst_escapes AND y.worst_disruptive <= x.worst_disruptive
        AND (y.worst_false_interventions < x.worst_false_interventions OR y.worst_escapes < x.worst_escapes OR y.worst_disruptive < x.worst_disruptive)) THEN 'dominated' ELSE 'frontier' END AS verdict FROM g x""", "v_scored"))
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate by its worst seed against the shipped policy, and why it is out or stays."""
    return replay.compared(_replayed(spark, sf_dir), _SHIPPED)


# -- functions in SQL ----------------------------------------------------------------------------------------------------


@query(views.sql("""SELECT source, n, k, round(greatest(0, (k / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 9) AS low,
        round(least(1, (k / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 9) AS high,
        round(CASE WHEN k / n >= 0.5 THEN 1 ELSE exp(-2 * n * (0.5 - k / n) ** 2) END, 9)::DOUBLE AS p_value
    FROM (SELECT source, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM v_scored GROUP BY 1)""", "v_scored"))
def statistics_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals and p-values by functions that are registered in the session and called from SQL alone."""
    sqlfunctions.register(spark)
    rows = views.scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    return spark.sql(
        "SELECT source, n::DOUBLE AS n, k::DOUBLE AS k, round(wilson_lo(k, n), 9) AS low, round(wilson_hi(k, n), 9) AS high, round(hoeffding_p(k / n, n, 0.5D), 9) AS p_value FROM {rows}", rows=rows
    )


@query()
def sentences_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by a table function; they have to equal those of the query sentences."""
    sqlfunctions.register(spark)
    return spark.sql("SELECT d.doc_id, s.idx AS at, s.sentence FROM {docs} d, LATERAL sentences_of(d.text) s", docs=views.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def pii_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in all documents by a table function; they have to equal those of the query pii_spans."""
    sqlfunctions.register(spark)
    return spark.sql("SELECT d.doc_id, p.* FROM {docs} d, LATERAL pii_of(d.text) p", docs=views.table(spark, sf_dir, "documents").select("doc_id", "text"))
