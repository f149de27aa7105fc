"""Passages in documents, and scores of documents whose texts are taken apart once."""

import math

from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import retrieval as R


def test_passages_that_begin_and_end_within_words(spark):
    texts = ["a pretense of rainfalls", "tense of rain", "so tense  of rain", "of", "x", "tens of rain", None, "", "tense\nof rain", "often rain"]
    passages = ["tense of rain", "of", "", None, "tense of", " of ", "ten rain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "item long, passage string")
    got = sorted((r["item"], r["doc"]) for r in R.holders(docs, asked, "doc", "text", "item", "passage").collect())
    assert got == [(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t]


def test_scores_of_words(spark):
    texts = ["red ring ring", "red", "", None, "blue ring box box", "box"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    asked = spark.createDataFrame([(1, "Ring red"), (2, "box none"), (3, "")], "item long, query string")
    out = R.bm25(docs, asked, "doc", "text", "item", "query")
    ws = [(t or "").split() for t in texts]
    mean, want = sum(map(len, ws)) / len(ws), {}
    for i, q in ((1, ["ring", "red"]), (2, ["box", "none"])):
        for d, w in enumerate(ws):
            for t in set(q) & set(w):
                n, tf = sum(t in x for x in ws), w.count(t)
                want[i, d] = want.get((i, d), 0) + math.log(1 + (len(ws) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {(r["item"], r["doc"]): r["score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())


def test_texts_are_taken_apart_once(spark, monkeypatch):
    taken, real = [], X.words
    monkeypatch.setattr(X, "words", lambda c: taken.append(str(c)) or real(c))
    docs = spark.range(3).select(F.col("id").alias("doc"), F.lit("red ring").alias("text"))
    R.bm25(docs, spark.range(1).select(F.col("id").alias("item"), F.lit("red").alias("query")), "doc", "text", "item", "query")
    assert sum("text" in c for c in taken) == 1
