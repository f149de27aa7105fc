"""Toxicity by non-negative positive-unlabelled learning.

Method: a linear numpy classifier is trained from confirmed toxic texts and unlabelled texts. Its risk is
the class-prior-corrected estimate: prior * risk of positives as positive, plus the unlabelled risk as
negative less prior * risk of positives as negative; that second part is kept from going below zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.batches import beside
from loamgrid.plans.durable import durable

#: Bounds of the fit: toxic texts and unlabelled texts.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
FEATURE_SCHEMA = "positive boolean, unlabelled boolean, buckets array<int>"
_WORD = re.compile(r"\w+")


class _WordBuckets(dict):
    """Buckets of a word and of its beginnings, those of ``only`` if given; forgets all at ``limit`` words, so its memory is bounded."""

    def __init__(self, only: Collection[int] | None = None, limit: int = 100_000):
        self.only, self.limit = only, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        parts = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
        found = (zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)
        value = self[word] = tuple(found) if self.only is None else tuple(b for b in found if b in self.only)
        return value

    def of(self, text: str | None) -> set[int]:
        """Hashed features of a whole text: its distinct words and their beginnings."""
        return set(chain.from_iterable(map(self.__getitem__, set(_WORD.findall((text or "").lower())))))


@dataclass
class NnpuModel:
    """Weights by bucket, a bias, and the prior they were fitted with."""

    bias: float = -6.0
    prior: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], buckets: _WordBuckets | None = None) -> np.ndarray:
        """Of each text; ``buckets`` remembers words from one call to the next."""
        buckets = _WordBuckets(self.weights) if buckets is None else buckets
        g = np.array([self.bias + sum([self.weights[b] for b in sorted(buckets.of(t))]) for t in texts], float)
        return _sigmoid(g)


def chosen_features(sample: DataFrame, prior: float, least_share: float = 0.6, least_z: float = 3.5) -> np.ndarray:
    """Buckets whose texts are mostly toxic by the class-prior-corrected share prior * P(bucket | toxic) / P(bucket).

    Both a share of ``least_share`` and a log ratio ``least_z`` standard errors above 0 are asked for; all that pass stay.
    The driver gets one number for each, of BUCKETS at most, and few pass in a sample of bounded size.
    """
    sizes = sample.agg(F.count_if("positive").alias("n_p"), F.count_if("unlabelled").alias("n_u"))
    each = sample.select("positive", "unlabelled", F.explode("buckets").alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count_if("positive").alias("in_p"), F.count_if("unlabelled").alias("in_u")).where("in_p >= 3")
    p, u = (F.col("in_p") + 0.5) / (F.col("n_p") + 1), (F.col("in_u") + 0.5) / (F.col("n_u") + 1)
    z = F.log(p / u) / F.sqrt(1 / (F.col("in_p") + 0.5) + 1 / (F.col("in_u") + 0.5))
    good = counted.crossJoin(F.broadcast(sizes)).where((z > least_z) & (prior * p / u > least_share))
    return np.sort([r["bucket"] for r in good.select("bucket").collect()]).astype(np.int64)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def risk_and_step(w: np.ndarray, positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient to follow) of the class-prior-corrected risk with logistic loss.

    Weights end with the bias; texts are (features, their text, number of texts). The negative part is the
    unlabelled risk as negative less prior * that of the positives as negative. It is the risk of true negatives
    and can't be below zero; where its estimate is, the step goes back along it alone.
    """
    (pi, pd_, n_p), (ui, ud, n_u), k = positive, unlabelled, len(w) - 1
    gp = np.bincount(pd_, w[pi], n_p) + w[k]
    gu = np.bincount(ud, w[ui], n_u) + w[k]
    as_positive, negative = prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    negative_u, negative_p = _sigmoid(gu) / n_u, -prior * _sigmoid(gp) / n_p
    if negative >= 0:
        rp, ru = -prior * (1 - _sigmoid(gp)) / n_p + negative_p, negative_u
    else:
        rp, ru = -negative_p, -negative_u
    return float(as_positive), float(negative), np.r_[np.bincount(pi, rp[pd_], k) + np.bincount(ui, ru[ud], k), rp.sum() + ru.sum()]


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 2e-5) -> NnpuModel:
    """Adam on the non-negative risk, over the ``chosen`` buckets of each text.

    Without positives nothing is toxic; without unlabelled texts or buckets every text scores the prior.
    """
    if not positive or not unlabelled or not 0 < prior < 1 or not len(chosen):
        return NnpuModel(float(np.log(prior / (1 - prior))) if 0 < prior < 1 else NnpuModel.bias, prior)
    where = np.full(BUCKETS, -1)
    where[chosen] = np.arange(len(chosen))

    def sparse(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        parts = [(x := where[d])[x >= 0] for d in docs]
        return np.concatenate(parts), np.repeat(np.arange(len(docs)), [len(p) for p in parts]), len(docs)

    p, u, k = sparse(positive), sparse(unlabelled), len(chosen)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        grad = risk_and_step(w, p, u, prior)[2]
        grad[:k] += l2 * w[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return NnpuModel(float(w[k]), prior, dict(zip(chosen.tolist(), w[:k].tolist(), strict=True)))


def in_training(doc_id: Column) -> Column:
    """Whether labels of a row may be learnt from: the CRC-32 of its id as text is not divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _share(salt: str, share: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> NnpuModel:
    """A model from toxic rows of ``labels`` (doc_id, toxic) and texts of ``docs`` (doc_id, text), training rows only.

    The prior is the share of toxic rows among the labelled ones whose texts ``docs`` has, as it must be that of
    the unlabelled texts: where other steps have taken documents away, a prior of all labels is wrong for what
    is left. An id that any row labels toxic is toxic, and counts once. Expected sample sizes are ``max_positive``
    and ``max_unlabelled``, chosen by a hash of the id. Spark counts the buckets of the sample; the driver gets
    the chosen ones, and for each text of the sample which of these it holds.
    """
    seen = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = durable(seen.join(docs.select("doc_id"), "doc_id", "left_semi"))
    n, n_toxic = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(n_toxic / n, 1 - 1 / (n + 1)) if n else 0.0  # where all labelled rows are toxic, still not quite all others
    if not n_toxic:
        return NnpuModel()
    total = docs.count()
    wanted = seen.where((F.col("toxic") == 1) & _share("p", min(1.0, max_positive / n_toxic))).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.select("doc_id", "text").where(in_training(F.col("doc_id"))).join(F.broadcast(wanted), "doc_id", "left")
    rows = rows.withColumn("unlabelled", _share("u", min(1.0, max_unlabelled / max(1, total)))).where("positive or unlabelled")

    def features(batches: Iterator[pd.DataFrame], only: frozenset | None = None) -> Iterator[pd.DataFrame]:
        buckets = _WordBuckets(only)
        for b in batches:
            found = [buckets.of(t) for t in b["text"]]
            yield pd.DataFrame({"positive": b["positive"].eq(True), "unlabelled": b["unlabelled"], "buckets": [np.sort(np.fromiter(x, np.int32)) for x in found]})

    texts = rows.select("text", "positive", "unlabelled")
    chosen = chosen_features(texts.mapInPandas(features, FEATURE_SCHEMA), prior)
    only = frozenset(chosen.tolist())
    sample = texts.mapInPandas(lambda it: features(it, only), FEATURE_SCHEMA).toPandas()
    lists = [np.asarray(x, np.int64) for x in sample["buckets"]]
    positive = [x for x, p in zip(lists, sample["positive"], strict=True) if p]
    unlabelled = [x for x, u in zip(lists, sample["unlabelled"], strict=True) if u]
    return fit_nnpu(positive, unlabelled, prior, chosen)


def score_toxicity(docs: DataFrame, model: NnpuModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col`` double, 0 to 1, from each whole text alone.

    Defined cases: null and empty texts get the model's bias; equal texts get equal scores; without toxic
    labels all scores are near 0; an empty table gives an empty table; a column named ``score_col`` is
    replaced, other columns pass through.
    """
    rest = docs.drop(score_col)

    def scorer() -> Callable[[list[str | None]], list]:
        buckets = _WordBuckets(model.weights)
        return lambda texts: [model.scores(texts, buckets)]

    return beside(rest, rest.columns, [text_col], T.StructType([T.StructField(score_col, T.DoubleType())]), scorer)
