"""Links between records: by shared authors and topic, and answers to the sources behind the calls that they used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import graphs as G
from loamgrid.plans.durable import durable

#: The least score of a link, and the share of the best score that the runner-up may have.
LEAST_SCORE, MARGIN = 0.05, 0.80


def shared_author_links(specs: DataFrame, elements: DataFrame, scores: DataFrame, spec: str, element: str, author: str = "author", score: str = "score") -> DataFrame:
    """(spec, element, score, runner_up, candidates, authors): the best element of each spec's authors, where it stands apart.

    ``specs`` and ``elements`` have a row for each author of theirs, compared by ``author_key``; ``scores`` (spec, element, score) says how
    well texts match, and a pair that it lacks scores 0. Nothing is linked where the best scores under LEAST_SCORE or where
    the runner-up has over MARGIN of it. Equal scores go to the larger element, as in a descending sort of both.
    """
    named = lambda rows, key: rows.select(key, X.author_key(F.col(author)).alias("who")).where("who <> ''").distinct()
    pairs = named(specs, spec).join(named(elements, element), "who")
    via = pairs.groupBy(spec, element).agg(F.array_sort(F.collect_set("who")).alias("authors"))
    scored = via.join(scores.select(spec, element, F.col(score).cast("double").alias("score")), [spec, element], "left").na.fill(0.0, ["score"])
    w = Window.partitionBy(spec).orderBy(F.desc("score"), F.desc(element))
    led = scored.withColumns({"place": F.row_number().over(w), "runner_up": F.coalesce(F.lead("score").over(w), F.lit(0.0)), "candidates": F.count("*").over(Window.partitionBy(spec))}).where("place = 1")
    good = (F.col("score") >= LEAST_SCORE) & (F.col("runner_up") <= F.col("score") * MARGIN)
    return led.where(good).select(spec, element, "score", "runner_up", "candidates", "authors")


def places_in_words(values: DataFrame, value: str, most: int = 4096) -> tuple[DataFrame, bool]:
    """(value, word, bit) for each different value, null too, stored, and whether they are few enough (100,000) to be broadcast.

    A word is a number for 64 values. About ``most`` values share a bucket of words, and each bucket is numbered in a task of its own.
    """
    different = durable(values.select(value).distinct())
    n = different.count()
    bucket = F.pmod(F.xxhash64(value), F.lit(-(-n // most) or 1))
    placed = different.withColumn("__bucket", bucket).withColumn("__place", F.row_number().over(Window.partitionBy("__bucket").orderBy(value)) - 1)
    word = F.col("__bucket") * 2**32 + F.floor(F.col("__place") / 64)
    return durable(placed.select(value, word.alias("word"), F.expr("shiftleft(1L, cast(__place % 64 as int))").alias("bit"))), n <= 100_000


def sources_used(used: DataFrame, derived: DataFrame, sources: DataFrame, answer: str, call: str, source: str, failed: Column | None = None) -> DataFrame:
    """(answer, source), each once: the sources behind all calls that an answer used, directly or through what they were derived from.

    ``used`` is (answer, call), ``derived`` (src, dst) leads from a call to the calls that it worked on, ``sources`` is (call, source);
    rows of it for which ``failed`` holds are no sources. Sources are bits of words, which are gathered along ``derived`` for all calls
    at once, so a call is a row for each 64 sources and not one for each call behind it.
    """
    good = (sources if failed is None else sources.where(~F.coalesce(failed, F.lit(False)))).select(F.col(call).alias("node"), F.col(source).alias("__source"))
    places, few = places_in_words(good, "__source")
    places = F.broadcast(places) if few else places
    own = good.join(places.withColumnRenamed("__source", "__named"), F.col("__source").eqNullSafe(F.col("__named")))
    behind = G.gathered(derived, own.groupBy("node", "word").agg(F.bit_or("bit").alias("bits")))
    of_answer = used.select(F.col(answer).alias("__answer"), F.col(call).alias("node")).join(behind, "node").groupBy("__answer", "word").agg(F.bit_or("bits").alias("bits"))
    found = of_answer.join(places, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return found.select(F.col("__answer").alias(answer), F.col("__source").alias(source))
