"""Quality by hierarchical empirical Bayes.

Method: a document classifier gives each document a probability of good quality from its whole text;
grouped sums of these give host and path posteriors, each shrunk toward its parent (path to host, host to
the whole corpus) by a weight estimated from the spread between and inside groups; the document's evidence
and the offset of its path's posterior are added on the logit scale.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.batches import beside
from loamgrid.plans.durable import durable

#: Expected number of labelled rows that the classifier is fitted on; bins a feature.
MAX_LABELLED, BINS = 12_000, 8
#: Tables of sites up to this many rows are broadcast; their number is counted first.
BROADCAST_SITES = 20_000
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
_CLASS = np.zeros(256, np.int8)  # 0 other, 1 white space, 2 upper case, 3 lower case, 4 digit, 5 sentence marks, 6 symbols, 7 beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*|!<>{}[]=+~^_@\\/`"]] = 6
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "beyond_ascii", "pipes", "shouts", "distinct_words",
    "repeated_next", "short_words", "words_a_line", "repeated_lines", "symbol_words", "upper_words",
)


def features_of(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all 0 without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=8) / len(raw)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, share[2], share[4], share[5], share[6], share[7], words.count("|") / n, text.count("!") / n,
        len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, sum(1 for w in words if len(w) <= 3) / n, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), sum(1 for w in words if w[-1] in "#$%&*|") / n, sum(map(str.isupper, words)) / n,
    ]


@dataclass
class BinnedLogistic:
    """A logistic model with one weight for each bin of each feature."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def design(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        return bins + np.arange(x.shape[1]) * (self.edges.shape[1] + 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        g = self.bias + self.weights[self.design(x)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit_binned(x: np.ndarray, y: np.ndarray, bins: int = BINS, steps: int = 25, ridge: float = 3.0) -> BinnedLogistic:
    """Newton steps with a ridge; without both classes the model gives the share of good rows (0.5 without rows)."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    blank = np.zeros((width, bins - 1))
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return BinnedLogistic(blank, np.zeros(width * bins), float(np.log(share / (1 - share))))
    # edges between quantiles of either class, so that a rare class gets bins of its own
    q = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    cuts = [np.r_[np.quantile(x[y == 1, f], q), np.quantile(x[y == 0, f], q)] for f in range(width)]
    edges = np.stack([np.sort(np.r_[c, [c.max()] * (bins - 1 - len(c))]) for c in cuts])
    model = BinnedLogistic(edges, np.zeros(width * bins), float(np.log(y.mean() / (1 - y.mean()))))
    at = model.design(x)
    d = np.zeros((len(y), width * bins + 1), np.float32)
    d[np.arange(len(y))[:, None], at] = 1
    d[:, -1] = 1
    beta = np.r_[model.weights, model.bias]
    penalty = np.r_[np.full(width * bins, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        hessian = (d * (p * (1 - p))[:, None].astype(np.float32)).T @ d + np.diag(penalty)
        move = np.linalg.solve(hessian.astype(float), d.T @ (y - p) - penalty * beta)
        beta = beta + move
        if np.abs(move).max() < 1e-5:
            break
    return BinnedLogistic(edges, beta[:-1], float(beta[-1]))


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the fifth with a CRC-32 of the id divisible by 5 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> BinnedLogistic:
    """The document classifier, from about ``max_labelled`` training rows of ``labels`` (doc_id, quality) by a hash of the id."""
    seen = labels.where(in_training(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, max_labelled / max(1, seen.count()))
    chosen = seen.where(F.pmod(F.xxhash64("doc_id", F.lit("q")), F.lit(1_000_000)) < int(share * 1_000_000))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"good": (b["quality"] == 1).astype(float), "x": [features_of(t) for t in b["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")
    got = rows.mapInPandas(measured, "good double, x array<double>").toPandas()
    x = np.array(got["x"].to_list(), float).reshape(len(got), len(FEATURES))
    return fit_binned(x, got["good"].to_numpy(float))


def with_evidence(docs: DataFrame, model: BinnedLogistic, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with the classifier's ``evidence``, from whole texts."""
    kept = keep if keep is not None else [c for c in docs.columns if c != "evidence"]

    def scored(texts: list[str | None]) -> list:
        return [model.probability(np.array([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES)))]

    return beside(docs, kept, [text_col], "evidence double", lambda: scored)


def _shrinkage(groups: DataFrame) -> tuple[float, float]:
    """(mean, kappa) from (n, s, q) of each group: kappa is the variance inside groups over that between them.

    One row of sums reaches the driver. Kappa is kept between 1 and a million; with a single group it is the latter.
    """
    r = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    if not r["n"]:
        return 0.5, 1e6
    mean = r["s"] / r["n"]
    inside = max((r["q"] - r["b"]) / max(1, r["n"] - r["g"]), 1e-9)
    size = (r["n"] - r["nn"] / r["n"]) / max(1, r["g"] - 1)
    between = ((r["b"] - r["n"] * mean * mean) / max(1, r["g"] - 1) - inside) / size if r["g"] > 1 and size > 0 else 0.0
    return mean, min(max(inside / between, 1.0), 1e6) if between > 0 else 1e6


def site_posteriors(evidence: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """(host, path, n_docs, host_posterior, path_posterior, corpus_mean) by grouped sums over all rows.

    Null hosts and paths are groups of their own. Sums are combined before the shuffle, so a host with a
    third of all rows is one row a task there.
    """
    cells = durable(
        evidence.groupBy(F.col(host_col).alias("host"), F.col(path_col).alias("path"))
        .agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"))
    )
    hosts = cells.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, host_kappa = _shrinkage(hosts)
    _, path_kappa = _shrinkage(cells)
    hosts = hosts.select("host", ((F.lit(host_kappa * mean) + F.col("s")) / (F.lit(host_kappa) + F.col("n"))).alias("host_posterior"))
    joined = cells.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    path = (F.lit(path_kappa) * F.col("host_posterior") + F.col("s")) / (F.lit(path_kappa) + F.col("n"))
    return joined.select("host", "path", F.col("n").alias("n_docs"), "host_posterior", path.alias("path_posterior"), F.lit(mean).alias("corpus_mean"))


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


MADE = ("evidence", "n_docs", "host_posterior", "path_posterior", "quality_score")


def score_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with MADE: the document's evidence, its path's size, both posteriors and the combined score, 0 to 1.

    Texts are read twice, for the sums and for the rows, and never shuffled. The site table is broadcast
    only where a count has shown it to be small; a larger one is joined by its key, where the skew join
    splits a hot host.

    Defined cases: null and empty texts have features 0 and get the classifier's value for those; null hosts
    or paths are sites of their own; repeated rows count each; without labels the evidence is 0.5 for all;
    an empty table gives an empty table; columns named as in MADE are replaced, any others pass through.
    """
    names = [c for c in docs.columns if c not in MADE]
    model = train_quality(docs, labels, max_labelled)
    # columns go by number meanwhile, so that no name of theirs can meet one of the site table
    number = {c: f"c{k}" for k, c in enumerate(names)}
    rest = docs.toDF(*(number.get(c, f"gone{k}") for k, c in enumerate(docs.columns))).select(*number.values())
    host, path, text = number[host_col], number[path_col], number[text_col]
    sites = durable(site_posteriors(with_evidence(rest, model, text, [host] if host == path else [host, path]), host, path))
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    at = F.broadcast(sites) if small else sites
    rows = with_evidence(rest, model, text)
    joined = rows.join(at, F.col(host).eqNullSafe(F.col("host")) & F.col(path).eqNullSafe(F.col("path")), "left")
    total = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.col("corpus_mean"))
    out = joined.select(*number.values(), "evidence", "n_docs", "host_posterior", "path_posterior", 1 / (1 + F.exp(-total)))
    return out.toDF(*number, *MADE)
