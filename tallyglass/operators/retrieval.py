"""Retrieval in batches of queries: chunks, BM25, nearest vectors, rank fusion, cache lookups."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import storage
from tallyglass.functions import nearest, ranking, text, udfs

K1, B, RRF = 1.2, 0.75, 60
#: Probes and cached answers of a block; queries that are one block at most, and queries and vectors of a block beyond that.
PROBE_BLOCK, CACHE_BLOCK = 8192, 4096
BROADCAST_QUERIES, QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192, 8192
#: Postings that a block of documents has for a block of queries, about.
POSTING_BLOCK = 1 << 19


def chunk_texts(body: Column, least: int = 120, most: int = 700) -> Column:
    """Paragraphs as passages: short ones join the next, long ones are packed sentence by sentence."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    last = lambda acc: F.element_at(acc, -1)
    put = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
    none = F.array().cast("array<string>")
    short = lambda acc, p: (F.size(acc) > 0) & (F.length(last(acc)) < least) & (F.length(last(acc)) + F.length(p) + 2 <= most)
    merged = F.aggregate(paragraphs, none, lambda acc, p: F.when(short(acc, p), put(acc, F.concat(last(acc), F.lit("\n\n"), p))).otherwise(F.concat(acc, F.array(p))))
    fits = lambda acc, s: (F.size(acc) > 0) & (F.length(last(acc)) + F.length(s) + 1 <= most)

    def packed(p: Column) -> Column:
        parts = F.split(F.regexp_replace(p, r"([.!?])\s+", "$1\u0001"), "\u0001")
        return F.aggregate(parts, none, lambda acc, s: F.when(fits(acc, s), put(acc, F.concat(last(acc), F.lit(" "), s))).otherwise(F.concat(acc, F.array(s))))

    return F.flatten(F.transform(merged, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(packed(p))))


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, domain, provenance, title, text); a document of a heading only is one chunk."""
    title = F.regexp_extract("text", r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*$", 1)
    body = F.trim(F.regexp_replace("text", r"(?m)^\s{0,3}#{1,6}\s+.+$", ""))
    parts = chunk_texts(body)
    made = docs.withColumn("title", title).withColumn("_p", F.when(F.size(parts) > 0, parts).otherwise(F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))))
    out = made.select("doc_id", "domain", "provenance", "title", F.posexplode("_p").alias("ordinal", "body"))
    full = F.when(F.col("title") != "", F.concat("title", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    return out.select(F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "domain", "provenance", "title", full.alias("text"))


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, id, length, tf): the terms of a document are counted in its own row, without a shuffle.

    The ids are read once beforehand: only counts of documents that share an id are added up, where their lengths agree too.
    """
    names = ("term", id_col, "length", "tf")
    counted = lambda of: of.select(id_col, F.lower("text")).mapInArrow(udfs.term_counts(names), f"term string, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, length int, tf long")
    shared = docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").select(id_col)
    if shared.isEmpty():
        return counted(docs)
    shared = storage.stage(shared)
    same = F.col(f"a.{id_col}").eqNullSafe(F.col(f"b.{id_col}"))
    of = lambda how: counted(docs.alias("a").join(shared.alias("b"), same, how))
    return of("left_anti").unionByName(of("left_semi").groupBy("term", id_col, "length").agg(F.sum("tf").alias("tf")))


def write_index(docs: DataFrame, path: str, embedder: str, dim: int) -> None:
    """Postings with what they were made with; an index at the path is replaced."""
    postings(docs).write.mode("overwrite").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(embedder, dim)], "embedder string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str, embedder: str, dim: int) -> DataFrame:
    """An index's postings, for reading; one made with another embedder or width is refused before any query."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta["embedder"], meta["dim"]) != (embedder, dim):
        raise ValueError(f"the index was made with {meta['embedder']} of {meta['dim']} components, not {embedder} of {dim}")
    return spark.read.parquet(f"{path}/postings")


def bm25(queries: DataFrame, index: DataFrame, n_docs: int, mean_length: float, k: int = 20, id_col: str = "doc_id", often: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best for each query, exactly.

    Queries all of whose terms have at most ``often`` postings (a fiftieth of the documents, 1,000 at least) meet these one by one.
    The others meet all postings of their terms a block of documents at a time, of which only the best go on.
    """
    often = often or max(1000, n_docs // 50)
    tf_part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    idf = F.ln(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).filter(F.length("term") > 1)
    terms = storage.stage(asked.join(index.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("idf", idf))
    kinds = terms.groupBy("query_id").agg((F.max("df") > often).alias("_frequent"))
    rare, frequent = kinds.agg(F.count_if(~F.col("_frequent")), F.count_if("_frequent")).first()
    of = lambda kind: terms.join(kinds.filter(kind), "query_id", "left_semi")
    parts, scores = index.select("term", id_col, tf_part.alias("part")), []
    if rare or not frequent:
        met = parts.join(of("not _frequent").select("query_id", "term", "idf"), "term")
        scores.append(met.groupBy("query_id", id_col).agg(F.sum(F.col("idf") * F.col("part")).alias("score")))
    if frequent:
        scores.append(_best_of_blocks(of("_frequent"), frequent, parts, k, id_col))
    return top(reduce(DataFrame.unionByName, scores), "query_id", F.round("score", 9), id_col, k)


def _best_of_blocks(terms: DataFrame, queries: int, parts: DataFrame, k: int, id_col: str) -> DataFrame:
    """(query_id, id, score) that can be among the k best of a query: those of each block of documents, from all postings asked for.

    A posting is dealt once to its document's block for each block of queries, so that no pair of a query and a document is shuffled.
    """
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    blocks = -(-queries // QUERY_BLOCK)
    asked = terms.withColumn("_b", deal("query_id", blocks))
    wanted = asked.select("term", "_b", "df").distinct()
    places = max(1, -(-(wanted.agg(F.sum("df")).first()[0] or 0) // (blocks * POSTING_BLOCK)))
    met = parts.join(wanted.select("term", "_b"), "term").select(F.struct("_b", deal(id_col, places).alias("_p")).alias("_met"), "term", id_col, "part")
    every = asked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    asking = every.select(F.struct("_b", "_p").alias("_meets"), "query_id", "term", "idf")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        query, name, score = ranking.best(a["query_id"], a["term"], a["idf"], b["term"], b[id_col], b["part"], k)
        return pa.table({"query_id": query, id_col: name, "score": score})

    return asking.groupBy("_meets").cogroup(met.groupBy("_met")).applyInArrow(best, _fields(asking, "query_id", met, id_col) + ", score double")


def top(scores: DataFrame, key: str, score: Column, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(score.desc(), F.col(id_col))
    return scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without direction, null if one or a component is missing, else within [-1, 1]."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).when(norms.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 20, broadcast: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by Euclidean distance, for a set of queries that the caller states.

    Queries and vectors meet in blocks of both, up to ``broadcast`` queries in one block. In a task a matrix product leaves
    out what is too far, and of the rest a block keeps those that can be among the k best of a query once rounded.
    """
    few = queries.limit(broadcast + 1).count() <= broadcast
    blocks, parts = 1 if few else -(-queries.count() // QUERY_BLOCK), max(1, -(-vectors.count() // VECTOR_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = vectors.select("vec_id", "embedding").withColumn("_p", deal("vec_id", parts)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.select("query_id", "q").withColumn("_b", deal("query_id", blocks)).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, names = a["query_id"].to_numpy(), b["vec_id"].to_numpy()
        i, j, d = nearest.nearest(*nearest.pair(a["q"], b["embedding"]), asked, names, k)
        return pa.table({"query_id": a["query_id"].take(pa.array(i, pa.int64())), "vec_id": b["vec_id"].take(pa.array(j, pa.int64())), "distance": pa.array(d, pa.float64(), mask=d < 0)})

    found = q.groupBy("_b", "_p").cogroup(v.groupBy("_b", "_p")).applyInArrow(near, _fields(q, "query_id", v, "vec_id") + ", distance double")
    best = found.withColumn("distance", F.round("distance", 9))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")) - 1).filter(F.col("rank") < k).select("query_id", "vec_id", "distance", "rank")


def _fields(a: DataFrame, first: str, b: DataFrame, second: str) -> str:
    return f"{first} {a.schema[first].dataType.simpleString()}, {second} {b.schema[second].dataType.simpleString()}"


def fused(lexical: DataFrame, dense: DataFrame, id_col: str, dense_weight: float = 0.5, k: int = 10) -> DataFrame:
    """Reciprocal ranks of both lists, summed; found_by says which had it."""
    a, b = lexical.select("query_id", id_col, F.col("rank").alias("ra")), dense.select("query_id", id_col, F.col("rank").alias("rb"))
    part = lambda r, w: F.coalesce(F.lit(w) / (RRF + F.col(r) + 1), F.lit(0.0))
    both = a.join(b, ["query_id", id_col], "full").withColumn("score", F.round(part("ra", 1.0) + part("rb", dense_weight), 9))
    by = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "both").when(F.col("ra").isNotNull(), "lexical").otherwise("dense")
    return top(both, "query_id", F.col("score"), id_col, k).select("query_id", id_col, "score", "rank", by.alias("found_by"))


def context_key(fragments: Column) -> Column:
    """A digest of fragments whatever their order."""
    lines = F.array_sort(F.transform(fragments, lambda f: F.concat_ws("|", f["doc_id"], f["text"])))
    return F.left(F.sha2(F.array_join(lines, "\u0001"), 256), F.lit(32))


def cache_probe(probes: DataFrame, cached: DataFrame, least: float = 0.95) -> DataFrame:
    """The best cached answer of the same context, policy and scope, if it is similar enough.

    The probes and the cached answers of a scope are cut into blocks, and every block of probes meets every block of answers,
    so no task compares all of a large scope. In a task a matrix product leaves out what can't be a probe's best; equal
    vectors of a scope are compared once, for their smallest id.
    """
    scope = ["context", "policy", "scope"]
    probes, cached = probes.filter("embedding is not null"), cached.filter("cached_embedding is not null")
    cached = cached.groupBy(*scope, "cached_embedding").agg(F.min("cache_id").alias("cache_id"))
    count = lambda of, most: of.groupBy(*scope).agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    blocks = count(cached, CACHE_BLOCK).withColumnRenamed("n", "_nc").join(count(probes, PROBE_BLOCK).withColumnRenamed("n", "_np"), scope)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = [*scope, "_c", "_p"]
    dealt = cached.join(blocks, scope).withColumn("_c", own("cache_id", "_nc")).withColumn("_p", every("_np")).select(F.struct(*key).alias("_met"), "cache_id", "cached_embedding")
    asking = probes.join(blocks, scope).withColumn("_p", own("probe_id", "_np")).withColumn("_c", every("_nc")).select(F.struct(*key).alias("_meets"), "probe_id", "embedding")

    def similar(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, c = nearest.most_similar(*nearest.pair(a["embedding"], b["cached_embedding"]), b["cache_id"].to_numpy(), least)
        return pa.table({"probe_id": a["probe_id"].take(pa.array(i, pa.int64())), "cache_id": b["cache_id"].take(pa.array(j, pa.int64())), "similarity": pa.array(c, pa.float64())})

    found = asking.groupBy("_meets").cogroup(dealt.groupBy("_met")).applyInArrow(similar, _fields(asking, "probe_id", dealt, "cache_id") + ", similarity double")
    met = found.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= least)
    best = met.groupBy("probe_id").agg(F.max_by(F.struct("cache_id", "similarity"), F.struct(F.col("similarity"), -F.col("cache_id"))).alias("b"))
    return best.select("probe_id", "b.cache_id", "b.similarity")


def conflicts(fragments: DataFrame, key: str) -> DataFrame:
    """Share of pairs of fragments in one key and domain that give different figures. Pairs are counted, not made: all
    pairs of a domain less those with equal sets of figures."""
    f = fragments.withColumn("_f", F.array_sort(F.array_distinct(text.figures(F.col("text"))))).filter(F.size("_f") > 0)
    same = f.groupBy(key, "domain", "_f").agg(F.count("*").alias("n"))
    by = same.groupBy(key, "domain").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("equal"))
    out = by.groupBy(key).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("equal").alias("equal"))
    return out.select(key, F.when(F.col("pairs") > 0, F.round((F.col("pairs") - F.col("equal")) / F.col("pairs"), 9)).otherwise(0.0).alias("conflict"))
