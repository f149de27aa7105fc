"""Near duplicates by a chosen-path set similarity join.

Method: every document walks down independent random trees. A node picks a few of the minwise
coordinates, and the documents in it branch by their values there; on average one over the threshold
branches leave a node, so that a pair at the threshold keeps meeting while others part. Nodes small
enough are compared exhaustively; larger ones branch on. The number of trees sets the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.batches import beside
from loamgrid.llm.ids import named, numbered
from loamgrid.llm.shingles import minwise, set_digest, shingle_set
from loamgrid.operators.components import connected_components
from loamgrid.plans.durable import durable, evenly

#: Minwise coordinates a document; trees; documents that a node may hold to be compared exhaustively.
COORDINATES, TREES, SMALL = 64, 12, 4096
#: Trees that documents of nodes over SMALL walk down besides, by as many coordinates of their own.
DEEP_TREES = 48
#: Documents in a block of a comparison.
BLOCK = 1024
#: Documents of a cluster over BLOCK that meet all others of it; hits of an inverted list that are counted at a time.
HEADS, HITS = 4, 2_000_000
#: Up to so many ids, which are counted, go to every task (16 bytes each), so that only texts of these documents move.
BROADCAST_IDS = 2_000_000
#: Rounds of branching (one step, then two each); what is still over SMALL then is compared block by block.
ROUNDS = 4


def _features(texts: list[str | None], size: int) -> list[list]:
    seeds = np.random.default_rng(20240229).integers(1, 2**63, COORDINATES, dtype=np.uint64)
    sets = [shingle_set(t, size) for t in texts]
    return [[len(s) for s in sets], [set_digest(s) if len(s) else None for s in sets], [minwise(s, seeds) if len(s) else None for s in sets]]


def _more_mins(texts: list[str | None], size: int) -> list[list]:
    seeds = np.random.default_rng(20240301).integers(1, 2**63, COORDINATES, dtype=np.uint64)
    return [[minwise(shingle_set(t, size), seeds) for t in texts]]


def _sets(texts: list[str | None], size: int) -> list[list]:
    return [[shingle_set(t, size).tobytes() for t in texts]]


def _branches(steps: int, expected: float) -> list[F.Column]:
    """Columns for ``steps`` steps down: at each node one coordinate, and a second with probability ``expected`` - 1."""
    thousandths = round((expected - 1) * 1000)
    nodes = F.array("node")
    for _ in range(steps):
        first = lambda n: F.pmod(F.xxhash64(n, F.lit("a")), F.lit(COORDINATES)).cast("int")
        second = lambda n: F.pmod(F.xxhash64(n, F.lit("b")), F.lit(COORDINATES)).cast("int")
        both = lambda n: (F.pmod(F.xxhash64(n, F.lit("c")), F.lit(1000)) < thousandths) & (first(n) != second(n))
        down = lambda n, c: F.xxhash64(n, c, F.get("mins", c))
        nodes = F.flatten(
            F.transform(nodes, lambda n: F.when(both(n), F.array(down(n, first(n)), down(n, second(n)))).otherwise(F.array(down(n, first(n)))))
        )
    return nodes


class Forest:
    """Sets of indexes below ``n`` that grow together: a parent for each, so memory doesn't follow the number of edges."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join ``a[k]`` and ``b[k]`` for all k."""
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            self.parent[np.maximum(ra, rb)] = np.minimum(ra, rb)  # the last edge of each root wins
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest: each index that isn't the smallest of its set, and that smallest."""
        moved = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return moved, self.parent[moved]


def _join_close(forest: Forest, mins: np.ndarray, left: int, least: int) -> None:
    """Join the rows that agree in at least ``least`` coordinates: any two, or (``left`` below their number) one of the first ``left`` with one of the others.

    Some rows at a time against all; what they join goes into ``forest`` at once and no pairs are kept.
    """
    n, within = len(mins), left == len(mins)
    right = mins if within else mins[left:]
    step = max(1, 500_000 // len(right))
    columns = np.ascontiguousarray(right.T)
    for k in range(0, left, step):
        part = mins[k : min(left, k + step)]
        agree = np.zeros((len(part), len(right)), np.int8 if mins.shape[1] < 128 else np.int16)
        for c in range(mins.shape[1]):
            agree += part[:, c, None] == columns[c]
        i, j = np.nonzero(agree >= least)
        forest.add(i + k, j if within else j + left)
        if not forest.parent.any():  # all are one set already
            return


def _compare_nodes(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Candidate edges of each unit (a node, or two blocks of one): a spanning forest of the pairs that agree in enough coordinates.

    Rows of a unit come one after the other, side 0 first; a unit that a batch cuts waits for the next batch.
    """

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        doc, side = part["doc"].to_numpy(), part["side"].to_numpy()
        new = (np.diff(part["unit"].to_numpy()) != 0) | (np.diff(part["i"].to_numpy()) != 0) | (np.diff(part["j"].to_numpy()) != 0)
        starts = np.r_[0, np.flatnonzero(new) + 1]
        sizes = np.diff(np.r_[starts, len(doc)])
        mins = np.stack(part["mins"].to_list())
        two = starts[(sizes == 2)]
        two = two[(mins[two] == mins[two + 1]).sum(axis=1) >= least]
        src, dst = [doc[two]], [doc[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            forest = Forest(n)
            left = n - int(side[s : s + n].sum())
            _join_close(forest, mins[s : s + n], left or n, least)
            a, b = forest.edges()
            src.append(doc[s + a])
            dst.append(doc[s + b])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rest):
            last = rest.iloc[-1]
            whole = ((rest["unit"] != last["unit"]) | (rest["i"] != last["i"]) | (rest["j"] != last["j"])).to_numpy()
            if whole.any():
                yield edges(rest[whole])
                rest = rest[~whole]
    if rest is not None and len(rest):
        yield edges(rest)


def linked_pairs(sets: list[np.ndarray], percent: int, other: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set, the right ones with 100 * intersection >= percent * union, exactly; within ``sets`` (later ones only), or between it and ``other``.

    An inverted list of the right side's shingles gives a left set its intersection sizes in one count.
    """
    right = sets if other is None else other
    sizes = np.array([len(s) for s in right])
    owner = np.repeat(np.arange(len(right), dtype=np.int32), sizes)
    tokens = np.concatenate(right) if len(right) else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        width, common = hi - lo, np.zeros(len(right), np.int64)
        ends = np.cumsum(width)
        cuts = np.r_[0, np.searchsorted(ends, np.arange(HITS, ends[-1] if len(ends) else 0, HITS), "right"), len(s)]
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # long texts in parts of about HITS hits
            w = width[p:q]
            at = np.repeat(lo[p:q] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum()) if q > p else np.empty(0, np.int64)
            common += np.bincount(owner[at], minlength=len(right))
        j = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (common > 0))
        yield i, j[j > i] if other is None else j


def _confirm(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the confirmed links of one group: all its pairs, or those between its two sides."""
    group = group.drop_duplicates(["doc", "side"]).sort_values(["side", "doc"])
    docs = group["doc"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    left = int((group["side"] == 0).sum())
    within = left in (0, len(docs))
    forest = Forest(len(docs))
    for i, j in linked_pairs(sets, percent) if within else linked_pairs(sets[:left], percent, sets[left:]):
        forest.add(np.full(len(j), i), j if within else j + left)
    a, b = forest.edges()
    return pd.DataFrame({"src": docs[a], "dst": docs[b]})


def _block(salt: str, block: int) -> F.Column:
    """A document's block in a unit of ``n`` documents."""
    return F.pmod(F.xxhash64("doc", F.lit(salt)), F.ceil(F.col("n") / block)).cast("int")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Rows (unit, n, doc) keyed by (unit, i, j): units over ``block`` documents become pairs of blocks, each row once for each of its pairs."""
    mine, blocks = _block("block", block), F.ceil(F.col("n") / block).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when((mine > o), 1).otherwise(0).alias("side")))
    return rows.select("unit", "doc", F.explode(pairs).alias("p")).select("unit", "p.*", "doc")


def _chunked(sized: DataFrame, block: int) -> DataFrame:
    """Clusters (component, n, doc) keyed as (unit, i, j): each in chunks of about ``block`` documents, with HEADS of its documents in every chunk."""
    mine = sized.select("component", F.lit(0).alias("i"), _block("chunk", block).alias("j"), F.lit(0).alias("side"), "doc")
    chosen = F.array([F.min_by("doc", F.xxhash64("doc", F.lit(f"head{k}"))) for k in range(HEADS)])
    heads = sized.where(F.col("n") > block).groupBy("component", "n").agg(F.array_distinct(chosen).alias("heads"))
    chunks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("j")
    copies = heads.select("component", F.lit(0).alias("i"), chunks, F.lit(0).alias("side"), "heads").withColumn("doc", F.explode("heads")).drop("heads")
    return mine.unionByName(copies).withColumnRenamed("component", "unit")


def _left_over(sized: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Clusters over ``block`` documents that ``found`` leaves in several parts: (component, n, doc, outside, n_outside).

    Outside is what isn't in a cluster's largest part; only pairs with a document from there can still join parts.
    """
    parts = sized.where(F.col("n") > block).join(found.select(F.col("node").alias("doc"), F.col("component").alias("found")), "doc", "left")
    parts = parts.withColumn("part", F.coalesce("found", "doc")).drop("found")
    sizes = parts.groupBy("component", "n", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("component", "n").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.max("k").alias("k"))
    open_ones = evenly(largest.where("k < n").select("component", "main", (F.col("n") - F.col("k")).alias("n_outside")), "component")
    return parts.join(open_ones, "component").withColumn("outside", F.col("part") != F.col("main")).select("component", "n", "doc", "outside", "n_outside")


def _outside_pairs(rest: DataFrame, block: int) -> DataFrame:
    """Rows of ``_left_over`` keyed by (unit, i, j): blocks of the outside against blocks of all of the cluster."""
    all_blocks, out_blocks = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("n_outside") / block).cast("int")
    out_mine = F.pmod(F.xxhash64("doc", F.lit("out")), out_blocks).cast("int")
    left = rest.where("outside").select("component", out_mine.alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"), F.lit(0).alias("side"), "doc")
    right = rest.select("component", F.explode(F.sequence(F.lit(0), out_blocks - 1)).alias("i"), _block("chunk", block).alias("j"), F.lit(1).alias("side"), "doc")
    return left.unionByName(right).withColumnRenamed("component", "unit")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose document is in ``ids`` (stored, each once)."""
    return texts.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "doc", "left_semi")


def _roots(reps: DataFrame, first: int, trees: int) -> DataFrame:
    """(doc, mins, node): each document at the roots of ``trees`` trees, numbered from ``first`` on."""
    numbers = F.explode(F.sequence(F.lit(first), F.lit(first + trees - 1))).alias("t")
    return reps.select("doc", "mins", numbers).select("doc", "mins", F.xxhash64(F.lit("tree"), "t").alias("node"))


def _walk(roots: DataFrame, reps: DataFrame, expected: float, small: int, steps: int, rounds: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Leaves, what is over ``small`` in the first round, and what still is after the last; (node, doc, n) rows or None.

    The first round goes ``steps`` down and each later one two; nodes of one document end, small ones become leaves.
    """
    level = roots.select("doc", F.explode(_branches(steps, expected)).alias("node"))
    level = level.distinct() if steps > 1 else level
    leaves, first = None, None
    for k in range(rounds):
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sized = durable(level.join(evenly(sizes, "node"), "node"))
        here = sized.where(F.col("n") <= small)
        leaves = here if leaves is None else leaves.unionByName(here)
        over = sized.where(F.col("n") > small)
        if over.limit(1).count() == 0:
            return leaves, first, None
        first = over if first is None else first
        if k < rounds - 1:
            level = over.select("node", "doc").join(reps, "doc").select("doc", F.explode(_branches(2, expected)).alias("node")).distinct()
    return leaves, first, over


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL, block: int = BLOCK, deep_trees: int = DEEP_TREES
) -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean), one row for each row of ``docs``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``words``-word
    shingles; component_id is the smallest id reachable, kept says that it is the row's own.

    Recall: at each level a pair at similarity s stays together with probability 1 - (1 - s)(1 - p s),
    p = 100 / percent - 1; at s = 0.8 that is 0.84 after one level, 0.64 after three and 0.44 after seven.
    The trees share the minwise values; averaged over these, twelve miss a pair at 0.8 with probability 8e-9
    after one level, but 6e-3 after seven. So documents of nodes that are split further also walk down
    ``deep_trees`` trees by coordinates of their own, of which 48 miss 6e-12 after three levels and 8e-6 after
    seven, 5e-8 with the twelve (taken as independent). The prefilter inside a node asks
    for agreement in 4.5 standard deviations fewer coordinates than a pair at the threshold has on average.
    All links are confirmed on the full sets; no pair that fails there is used.

    Skew: rows with equal sets are one node each from the start, whatever their number. A node over
    ``small`` documents branches on; smaller ones are compared by their minwise values in pairs of blocks of
    about ``block``, which leave spanning forests of candidates. The clusters that these make are compared on
    full sets: first in chunks of about ``block`` documents, with HEADS documents of the cluster in every chunk, so
    that a group of near copies becomes one part after each set was sent once; then only what is outside
    a cluster's largest part meets all of the cluster, in pairs of blocks, however many these are. What ROUNDS
    rounds can't part (sets that agree in nearly all coordinates) is one cluster. No task returns more than a spanning forest, so pairs inside a
    group are never listed, and joins of a hot group have a plain exchange on both sides.

    Defined cases: null and empty texts, and texts without words, have no shingles and link with nothing;
    ids should be unique, and rows that repeat an id get one row each with the id's smallest values;
    a null id gives a row with its set size, and component and kept null, and links with nothing; ids may be of any
    type that can be ordered, as text ids are numbered in their order meanwhile; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    expected = 100 / percent
    agree = max(1, int(np.floor(COORDINATES * (percent / 100) - 4.5 * np.sqrt(COORDINATES * (percent / 100) * (1 - percent / 100)))))
    texts, names = numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "doc")
    texts = texts if names is None else durable(texts)
    feats = durable(beside(texts, ["doc"], ["text"], "n_shingles long, digest binary, mins array<int>", lambda: lambda t: _features(t, words)))
    same = durable(feats.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.any_value("mins").alias("mins")))
    reps = same.select("doc", "mins")

    leaves, over, stuck = _walk(_roots(reps, 0, trees), reps, expected, small, 1, ROUNDS)
    if over is not None:  # both documents of a pair that meets in a node over ``small`` are here
        deep = durable(over.select("doc").distinct())
        again = durable(beside(_texts_of(texts, deep), ["doc"], ["text"], "mins array<int>", lambda: lambda t: _more_mins(t, words)))
        more, _, left = _walk(_roots(again, trees, deep_trees), again, expected, small, 3, ROUNDS - 1)
        leaves = leaves.unionByName(more)
        if left is not None:
            stuck = left if stuck is None else stuck.unionByName(left)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["unit", "i", "j"]
    met = _blocked(leaves.select(F.col("node").alias("unit"), "n", "doc"), block).join(reps, "doc").repartition(parts, *key).sortWithinPartitions(*key, "side")
    edges = met.mapInPandas(lambda it: _compare_nodes(it, agree), "src long, dst long").distinct()
    if stuck is not None:
        heads = evenly(stuck.groupBy("node").agg(F.min("doc").alias("head")), "node")
        edges = edges.unionByName(stuck.join(heads, "node").select(F.col("doc").alias("src"), F.col("head").alias("dst")))
    clusters = durable(connected_components(edges).select(F.col("node").alias("doc"), "component"))
    counts = evenly(clusters.groupBy("component").agg(F.count("*").alias("n")), "component")
    sized = durable(clusters.join(counts, "component"))

    def confirmed(keyed: DataFrame, ids: DataFrame) -> DataFrame:
        """Links on the full sets of the documents ``ids`` that ``keyed`` names, each made once."""
        sets = beside(_texts_of(texts, ids), ["doc"], ["text"], "shingles binary", lambda: lambda t: _sets(t, words)).dropDuplicates(["doc"])
        return keyed.join(sets, "doc").groupBy(*key).applyInPandas(lambda g: _confirm(g, percent), "src long, dst long")

    links = durable(confirmed(_chunked(sized, block), sized.select("doc")))
    linked = connected_components(links)
    if sized.where(F.col("n") > block).limit(1).count():
        rest = durable(_left_over(sized, linked, block))
        if rest.limit(1).count():
            more = confirmed(_outside_pairs(rest, block), rest.select("doc"))
            linked = connected_components(links.unionByName(more))

    # every document: its representative's component, mapped to the smallest id over all members
    rep_of = feats.join(same.select("digest", F.col("doc").alias("rep")), "digest", "left")
    placed = rep_of.join(evenly(linked, "node"), F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    out = placed.select("doc", F.col("n_shingles"), component.alias("component_id"), (F.col("doc") == component).alias("kept"))
    return named(out, names, ["doc", "component_id"], "doc").withColumnRenamed("doc", id_col)
