"""The registered queries of this folder, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import html, lm, minhash, mixing, neighbours, packing, repeats, rules, sharding, spelling, vectors, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mincut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op3_multinomial_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"), order=5)


def op5_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), capacity=2048, per_source=3)


def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, width=5)


def op7_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.learn(docs, _table(spark, sf_dir, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judged(docs, learned).select(*names, "rule")


def op8_cover_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = repeats.without_repeats(docs, width=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_multi_index_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), n_shards=8)


def op11_neighbour_vote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neighbours.scored(docs, neighbours.learn(docs, _table(spark, sf_dir, "labels")), good_from=0.7)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), most=32)


def op13_automaton_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), shortest=6, least=5, factor=5)


QUERIES = {
    "op1_mincut_main_text": op1_mincut_main_text,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_multinomial_mixture": op3_multinomial_mixture,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_conflict_best_fit": op5_conflict_best_fit,
    "op6_minmax_near_duplicates": op6_minmax_near_duplicates,
    "op7_decision_list_quality": op7_decision_list_quality,
    "op8_cover_anchor_repeats": op8_cover_anchor_repeats,
    "op9_multi_index_near_vectors": op9_multi_index_near_vectors,
    "op10_label_propagation_shards": op10_label_propagation_shards,
    "op11_neighbour_vote_quality": op11_neighbour_vote_quality,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_automaton_spelling_variants": op13_automaton_spelling_variants,
}


def _crc_table() -> list[int]:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: A-Z in lower case, and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op6_minmax_near_duplicates": f"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, shingle FROM (
                SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS list
                FROM w WHERE len(ws) > 0), unnest(list) AS t(shingle)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS MATERIALIZED (
            SELECT p.a, p.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
            WHERE 100 * hits >= 85 * (na.n + nb.n - hits)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_cover_anchor_repeats": f"""
        WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        p AS MATERIALIZED (
            SELECT doc_id, i AS pos, array_to_string(ws[i:i + 19], ' ') AS win
            FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
        later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM p) WHERE n > 1),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(0, 20) AS t(k)),
        lost AS (SELECT doc_id, list(pos) AS ats, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
            sha256(CASE WHEN lost.n IS NULL THEN array_to_string(ws, ' ')
                ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ats, i)), ' '), '') END) AS kept_sha256
        FROM w LEFT JOIN lost ON lost.doc_id = w.doc_id""",
    "op9_multi_index_near_vectors": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
        e AS MATERIALIZED (
            SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND p.n > 0 AND q.n > 0
            WHERE list_inner_product(p.x, q.x) / p.n / q.n >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
    "op13_automaton_spelling_variants": f"""
        WITH RECURSIVE r AS MATERIALIZED (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY 1, 2),
        h AS MATERIALIZED (
            SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
                lambda a, b: xor(a >> 8, list_extract({_crc_table()}, xor(a & 255, b) + 1)::BIGINT))) AS h
            FROM r),
        w AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        d AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
        e AS MATERIALIZED (
            SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.less = b.word
            UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.less = b.word),
        b AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM e GROUP BY word),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
                CASE WHEN b.most >= 5 * w.n THEN (SELECT min(e.near) FROM e WHERE e.word = w.word AND e.near_n = b.most) END AS form,
                CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
            FROM w LEFT JOIN b ON b.word = w.word),
        up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
        top AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
        SELECT f.word, f.form, top.root, f.n, f.n_near, f.form_n FROM f JOIN top ON top.word = f.word""",
}
