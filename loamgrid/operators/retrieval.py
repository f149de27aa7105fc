"""Search over documents: inverted-index scoring, vectors, fusion of ranked lists, budgets, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.plans.durable import durable

#: Up to so many different words of queries, which are counted, go to every task.
BROADCAST_TERMS = 100_000


def _exploded(docs: DataFrame, id_col: str, text_col: str, ended: bool = False) -> DataFrame:
    """(id, dl, term) a word. The length is computed below the explode, where a document is still one row. ``ended``: an empty term more, so that each document has a row."""
    sized = docs.select(id_col, X.words(F.col(text_col)).alias("ws"))
    return sized.select(id_col, F.size("ws").alias("dl"), F.explode(F.concat("ws", F.array(F.lit(""))) if ended else "ws").alias("term"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term, tf): one row a distinct word of a document."""
    return _exploded(docs, id_col, text_col).groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a word with a query.

    Only words of the queries are kept before anything is shuffled, where these are few enough (counted) to go to
    every task; the counts of the rest are stored, as two joins read them. An empty term that each document gets gives the
    corpus totals, one broadcast row, so texts are taken apart once.
    """
    wanted = queries.select(query_id, F.explode(F.array_distinct(X.words(F.col(query_text)))).alias("term"))
    terms = durable(wanted.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct())
    kept = F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms
    read = durable(_exploded(docs, id_col, text_col, ended=True).join(kept, "term", "left_semi").groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf")))
    totals = read.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    tf = read.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(totals)).select(id_col, "term", gain.alias("gain"))
    return weighted.join(wanted, "term").groupBy(query_id, id_col).agg(F.sum("gain").alias("score"))


def top_per(df: DataFrame, key: str, k: int, order: list[Column | str]) -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def idf_field_search(docs: DataFrame, queries: DataFrame, id_col: str, fields: dict[str, float], query_id: str, query_text: str) -> DataFrame:
    """(query_id, id, score): weights of the fields that hold a query stem, times ln((N+1)/(n+1)) + 1."""
    stems = lambda c: F.array_distinct(F.transform(X.words(F.col(c)), X.stem_plural))
    wanted = queries.select(query_id, F.explode(stems(query_text)).alias("term")).distinct()
    parts = None
    for name, weight in fields.items():
        one = docs.select(id_col, F.explode(stems(name)).alias("term"), F.lit(weight).alias("weight"))
        parts = one if parts is None else parts.unionByName(one)
    held = parts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy(id_col, "term").agg(F.sum("weight").alias("weight"))
    n = docs.agg(F.count("*").alias("n"))
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return held.join(df, "term").join(wanted, "term").groupBy(query_id, id_col).agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(size, F.lit(0.0)), F.lit(0.0))


def pooled(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, pooled): the mean vector of each group, component by component; partial sums are what is shuffled."""
    each = vectors.select(by, F.posexplode(vector).alias("__k", "__v"))
    mean = each.groupBy(by, "__k").agg(F.avg(F.col("__v").cast("double")).alias("__v"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda x: x["__v"]).alias("pooled"))


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the cosine and the distance of two vectors of equal width; null where either has no length."""
    difference = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return pairs.withColumns({"cosine": cosine(F.col(a), F.col(b)), "distance": F.sqrt(F.aggregate(difference, F.lit(0.0), lambda s, x: s + x))})


def unit_vector(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_refusal(v: Column, width: int) -> Column:
    """Why a vector can't be used: missing, width, not finite, all zero; else null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != width, "width").when(bad, "not finite").when(F.forall(v, lambda x: x == 0), "all zero")


def _nearest(names: np.ndarray, table: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = 256) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest rows of ``x`` for each of ``table``'s unit vectors, ``step`` of these at a time."""
    size = np.linalg.norm(x, axis=1)
    unit = (x / np.where(size > 0, size, 1)[:, None]).T
    for s in range(0, len(names), step):
        scores = np.round(table[s : s + step] @ unit, 9)
        scores[names[s : s + step, None] == ids[None, :]] = -np.inf
        first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
        rows = np.arange(len(scores))[:, None]
        out = pd.DataFrame({"q": np.repeat(names[s : s + step], first.shape[1]), "id": ids[first].reshape(-1), "cosine": scores[rows, first].reshape(-1)})
        yield out[np.isfinite(out["cosine"])]


def knn(queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, id_col: str, vector_col: str, k: int, block: int = 5000) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest vectors of each query, exactly.

    Up to ``block`` queries, which are counted, go to every task, and each batch of vectors leaves its own k
    best of a query. More queries are dealt into blocks of about ``block``, as the vectors are, and each
    pair of blocks is one task's matrix product, so no task and no driver holds more than two blocks.
    Rounded to 9 places; ties go to the smaller id.
    """
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("name"), unit_vector(F.col(query_vector)).alias("unit"))
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    found = "q long, id long, cosine double"
    n = q.count()
    if n <= block:
        rows = q.collect()
        names, table = np.array([r["name"] for r in rows], np.int64), np.array([r["unit"] for r in rows], np.float64)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(names):
                    yield from _nearest(names, table, b["id"].to_numpy(), np.stack(b["vector"].to_numpy()), k)

        best = v.mapInPandas(nearest, found)
    else:
        across, down = -(-n // block), max(1, -(-v.count() // block))
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        left = q.select(F.pmod(F.xxhash64("name"), F.lit(across)).alias("i"), every(down).alias("j"), "name", "unit")
        right = v.select(every(across).alias("i"), F.pmod(F.xxhash64("id"), F.lit(down)).alias("j"), "id", "vector")

        def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"q": [], "id": [], "cosine": []})
            parts = _nearest(a["name"].to_numpy(), np.stack(a["unit"].to_numpy()), b["id"].to_numpy(), np.stack(b["vector"].to_numpy()), k)
            return pd.concat(list(parts), ignore_index=True)

        best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(tile, found)
    return top_per(best, "q", k, [F.desc("cosine"), "id"]).withColumnsRenamed({"q": query_id, "id": id_col})


def rrf(lists: DataFrame, key: str, source: str, item: str, score: str, pos: str, k: int = 60) -> DataFrame:
    """(key, item, fused): the sum over sources of 1 / (k + rank), ranks by score and then position."""
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy(key, source).orderBy(F.desc(score), pos)))
    return ranked.groupBy(key, item).agg(F.sum(1 / (F.lit(k) + F.col("r"))).alias("fused"))


def cumulative_budget(df: DataFrame, key: str, order: list[Column | str], size: str, budget: int, most: int) -> DataFrame:
    """Rows in order while the running size fits, at most ``most``; the first always stays."""
    w = Window.partitionBy(key).orderBy(*order)
    run = df.withColumn("n", F.row_number().over(w)).withColumn("upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(((F.col("upto") <= budget) | (F.col("n") == 1)) & (F.col("n") <= most))


def holders(docs: DataFrame, passages: DataFrame, id_col: str, text_col: str, key: str, passage: str) -> DataFrame:
    """(key, id), each once: documents whose text holds a whole passage, letter by letter.

    They are found through the passage's longest word that white space bounds on both sides: its first and last may be parts
    of longer words in the document. A passage without such a word is held against every text.
    """
    ws = F.split("passage", r"\s+")
    inner = F.filter(F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    keyed = durable(passages.select(F.col(key), F.col(passage).alias("passage")).where("passage is not null").withColumn("word", longest))
    by_word = keyed.where("word is not null")
    by_word = F.broadcast(by_word) if by_word.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else by_word
    words = docs.select(id_col, F.explode(F.array_distinct(F.split(text_col, r"\s+"))).alias("word"))
    texts = docs.select(id_col, F.col(text_col).alias("__text"))
    likely = words.join(by_word, "word").select(key, id_col, "passage").join(texts, id_col)
    any_text = texts.join(keyed.where("word is null").select(key, "passage"), F.contains("__text", F.col("passage")))
    return likely.where(F.contains("__text", F.col("passage"))).select(key, id_col).unionByName(any_text.select(key, id_col)).distinct()


def retrieval_scores(hits: DataFrame, expected: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """(key, found, expected, recall, precision, reciprocal_rank) of ranked hits against expected items."""
    right = hits.where(F.col("rank") <= k).join(expected, [key, item])
    got = right.groupBy(key).agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    per = expected.groupBy(key).agg(F.count("*").alias("expected")).join(got, key, "left")
    found = F.coalesce("found", F.lit(0))
    return per.select(key, found.alias("found"), "expected", (found / F.col("expected")).alias("recall"), (found / F.lit(k)).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def select_passages(docs: DataFrame, id_col: str, text_col: str, term: Column, cap: int) -> DataFrame:
    """Paragraphs of each text: the first two, those with the term and their neighbours, up to ``cap`` characters in order."""
    parts = docs.select(id_col, term.alias("term"), F.posexplode(F.split(text_col, "\n")).alias("pos", "paragraph")).where(F.trim("paragraph") != "")
    w = Window.partitionBy(id_col).orderBy("pos")
    hit = F.contains(F.lower("paragraph"), F.col("term")).cast("int")
    near = parts.withColumn("near", F.max(hit).over(w.rowsBetween(-1, 1))).withColumn("n", F.row_number().over(w)).where("near = 1 or n <= 2")
    run = near.withColumn("upto", F.sum(F.length("paragraph")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("upto") <= cap).select(id_col, "pos", "paragraph")
