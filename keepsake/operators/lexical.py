"""Term statistics, BM25 and its mixture with vector scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.vectors import Best
from keepsake.runtime import cut

K1, B = 1.5, 0.75
#: Most cells of the weights (queries times distinct query terms) that are broadcast at once, and of the matrices
#: (rows times terms, rows times queries) that a task makes of a slice of its rows.
MOST_CELLS = 4_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def term_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, len): counts per document and term; documents without terms have no row."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), terms(F.col(text)).alias("t"))
    return t.select("doc", F.explode("t").alias("term"), F.size("t").alias("len")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(queries: DataFrame, query: str, query_text: str, docs: DataFrame, doc: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of every document that shares a term with a query; idf = ln((N - df + 0.5)/(df + 0.5) + 1).

    Repeated query terms count repeatedly. Documents are reduced to the terms
    that any query asks for before the join, and the join is on the term, salted
    by the document's hash so that a frequent term spreads over tasks.
    """
    q = queries.where(F.col(query_text).isNotNull()).select(F.col(query).alias("q"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
    counts = term_counts(docs, doc, text)
    size = docs.where(F.col(text).isNotNull()).select(F.size(terms(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("avgdl"))
    asked = counts.join(q.select("term").distinct(), "term", "left_semi")
    df = document_frequency(asked)
    n = F.coalesce(F.col("N"), F.lit(0))
    idf = df.join(F.broadcast(size)).select("term", "avgdl", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    weighted = q.join(idf, "term")
    salts = 8
    spread = weighted.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    hit = asked.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).join(spread, ["term", "salt"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hit.select(F.col("q"), "doc", part.alias("p")).groupBy("q", "doc").agg(F.sum("p").alias("score")).select(F.col("q").alias(query), F.col("doc").alias(doc), "score")


def _blocks(queries: DataFrame, query: str, query_text: str, have: DataFrame, vector: str | None = None):
    """(ids, words, weights, average length, query vectors) of blocks of stated queries, one at a time.

    Document frequencies of the asked terms are one aggregation, joined to the
    queries' terms in the shared folder; a block is what its hash gives, and the
    number of blocks follows from counts. ``have``: (doc, t) with term lists.
    """
    q = queries.where(F.col(query_text).isNotNull() & F.col(query).isNotNull())
    q = q.select(F.col(query).alias("q"), terms(F.col(query_text)).alias("t"), (F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("v"))
    asked = q.select("q", F.explode("t").alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("n"))
    frequency = have.select(F.explode(F.array_distinct("t")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = have.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("t")).alias("avgdl")).first()
    idf = F.log((F.lit(size["N"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    rows = asked.join(frequency.select("term", idf.alias("idf")), "term").groupBy("q").agg(F.collect_list(F.struct("term", (F.col("n") * F.col("idf")).alias("w"))).alias("ws"))
    q = cut(q.select("q", "v").join(rows, "q", "left"))  # one row per query
    n = q.agg(F.count(F.lit(1)).alias("q"), F.sum(F.size(F.coalesce("ws", F.array()))).alias("t"), F.max(F.coalesce(F.size("v"), F.lit(0))).alias("d")).first()
    blocks = max(1, -(-n["q"] * max(n["d"] or 0, 1) // MOST_CELLS), round((n["q"] * (n["t"] or 0) / MOST_CELLS) ** 0.5))
    for b in range(blocks if n["q"] else 0):
        mine = sorted(q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect(), key=lambda r: r["q"])
        words = {w: i for i, w in enumerate(sorted({x["term"] for r in mine for x in r["ws"] or []}))}
        weights = np.zeros((len(words), len(mine)))
        for j, r in enumerate(mine):
            for x in r["ws"] or []:
                weights[words[x["term"]], j] = x["w"]
        if mine:
            dim = max(len(r["v"] or []) for r in mine)
            yield np.array([r["q"] for r in mine], dtype=np.int64), words, weights, float(size["avgdl"] or 0.0), np.array([r["v"] or [0.0] * dim for r in mine]).reshape(len(mine), dim)


def _have(docs: DataFrame, doc: str, text: str, vector: str | None = None) -> DataFrame:
    cols = [F.col(doc).alias("doc"), terms(F.col(text)).alias("t")] + ([F.col(vector).cast("array<double>").alias("v")] if vector else [])
    have = docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull())
    return (have.where(F.col(vector).isNotNull()) if vector else have).select(*cols)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _matrices(shared, frames, k1: float, b: float):
    """(documents, BM25 scores, query x document; cosines or None) of slices of batches, each within MOST_CELLS."""
    ids, words, weights, avgdl, vectors = shared.value
    step = max(1, MOST_CELLS // max(1, len(words), len(ids)))
    for f in (f.iloc[at : at + step] for f in frames for at in range(0, len(f), step)):
        tf = np.zeros((len(f), len(words)))
        length = np.zeros(len(f))
        for i, t in enumerate(f["t"]):
            length[i] = len(t)
            np.add.at(tf[i], [words[w] for w in t if w in words], 1.0)
        scaled = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / avgdl))[:, None]) if avgdl else tf
        cosines = _unit(vectors) @ _unit(np.stack([np.asarray(v, dtype=np.float64) for v in f["v"]])).T if "v" in f else None
        yield f["doc"].to_numpy(), (scaled @ weights).T, cosines


def _best(make, k: int, digits: int, positive: bool):
    def run(frames):
        best = None
        for ids, docs, scores in make(frames):
            scores = np.round(scores, digits)
            best = best or Best(k, docs)
            best.add(np.where(scores > 0, scores, -np.inf) if positive else scores, docs)
        if best is not None:
            yield pd.DataFrame({"q": ids[best.q], "doc": best.ids, "score": best.s})

    return run


def _ranked(spark, parts: list[DataFrame], query: str, doc: str, k: int) -> DataFrame:
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    if found is None:
        found = spark.createDataFrame([], "q bigint, doc bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("doc").alias(doc), "score", "rank")


def bm25_top(queries: DataFrame, query: str, query_text: str, docs: DataFrame, doc: str, text: str, k: int, digits: int = 6, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score, rank): the k best documents by BM25 of a stated set of queries, ties by document.

    The same scores as ``bm25``, rounded, but nothing is paired: the weights of
    a block of queries are broadcast, at most ``MOST_CELLS`` at once, and each
    task multiplies slices of documents with them where these lie and keeps its
    k best per query. Each block is written and freed before the next. Ids must
    be bigint; a query id names one query.
    """
    spark, have, parts = docs.sparkSession, _have(docs, doc, text), []
    for block in _blocks(queries, query, query_text, have):
        shared = spark.sparkContext.broadcast(block)
        make = lambda frames, shared=shared: ((shared.value[0], d, s) for d, s, _ in _matrices(shared, frames, k1, b))
        parts.append(cut(have.mapInPandas(_best(make, k, digits, True), "q bigint, doc bigint, score double")))
        shared.destroy()
    return _ranked(spark, parts, query, doc, k)


def hybrid_top(
    queries: DataFrame, query: str, query_text: str, query_vector: str, docs: DataFrame, doc: str, text: str, vector: str, k: int, alpha: float = 0.5, scaled: bool = True, digits: int = 6
) -> DataFrame:
    """(query, doc, score, rank): the k best documents by ``alpha`` times BM25 and the rest cosine, ties by document.

    With ``scaled`` a query's BM25 scores are first scaled from their smallest
    to their largest among all documents, to 0 where all are equal; else they
    count as they are. Documents without text or vector take no part. Documents
    and a block of stated queries meet in matrices where the documents lie: a
    first pass finds each query's extremes, one row per query and task, a second
    keeps the k best per query and task. No pair of a query and a document is
    ever a row. Ids must be bigint; a query id names one query.
    """
    spark, have, parts = docs.sparkSession, _have(docs, doc, text, vector), []
    for block in _blocks(queries, query, query_text, have, query_vector):
        shared = spark.sparkContext.broadcast(block)

        def extremes(frames, shared=shared):
            low = high = None
            for _, s, _ in _matrices(shared, frames, K1, B):
                low = s.min(axis=1) if low is None else np.minimum(low, s.min(axis=1))
                high = s.max(axis=1) if high is None else np.maximum(high, s.max(axis=1))
            if low is not None:
                yield pd.DataFrame({"q": shared.value[0], "low": low, "high": high})

        ends = {r["q"]: (r["low"], r["high"]) for r in have.mapInPandas(extremes, "q bigint, low double, high double").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()} if scaled else {}
        low, high = (np.array([ends.get(q, (0.0, 0.0))[i] for q in block[0].tolist()])[:, None] for i in (0, 1))

        def make(frames, shared=shared, low=low, high=high):
            for d, s, c in _matrices(shared, frames, K1, B):
                yield shared.value[0], d, alpha * (np.where(high > low, (s - low) / (high - low + 1e-6), 0.0) if scaled else s) + (1 - alpha) * c

        parts.append(cut(have.mapInPandas(_best(make, k, digits, False), "q bigint, doc bigint, score double")))
        shared.destroy()
    return _ranked(spark, parts, query, doc, k)


def top_scores(scores: DataFrame, query: str, doc: str, k: int, digits: int | None = 6) -> DataFrame:
    """The k best rows per query, ties by document; scores rounded to ``digits`` first where given."""
    s = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc)))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)
