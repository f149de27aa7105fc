"""Hard negatives by Strassen products of anchor and candidate tiles.

Method: components are scaled and floored to int64; a tile of anchors meets a tile of candidates by Strassen's
recursion, with zero padding and exact integer additions; what a tile offers goes into small heaps (the best
positives of an anchor, the best rows of each positive's window), which merge across tiles and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable

#: Rows of a tile: anchors in a block, candidates that meet them at a time.
ANCHORS, CANDIDATES = 512, 2048
#: Tasks among which one block of anchors meets all candidates.
SPLITS = 32
#: Buckets that labels are dealt to at most, and rows of the table of their sizes that are counted and sent to every task.
BUCKETS, BROADCAST_SIZES = 4096, 100_000
#: A side of a product below which Strassen's recursion ends.
LEAF = 256
#: Squared lengths from here on take no part: a score could leave the range of a long.
MOST_SQUARED = float(2**62)


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product of small int64 tiles; by float64 only where every sum is proved to stay below 2^53."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top(a) * top(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 tiles by seven products of quarters, down to sides under ``leaf``; odd sides get a zero row or column.

    Sums wrap at 2^64 inside; the result is exact wherever it fits into a long, as arithmetic modulo 2^64 is a ring.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m) < leaf or k < 8:
        return _leaf(a, b)
    pad = lambda x: np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))
    a, b = pad(a), pad(b)
    i, j, p = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :p], b[:j, p:], b[j:, :p], b[j:, p:]
    m1, m2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    m3, m4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    m5, m6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * p), np.int64)
    out[:i, :p], out[:i, p:] = m1 + m4 - m5 + m7, m3 + m5
    out[i:, :p], out[i:, p:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:n, :m]


def merged(kept: tuple[np.ndarray, ...], ids: np.ndarray, scores: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` best of a heap (ids, scores, at) and new rows: higher scores first, ties by smaller id, then row number."""
    ids, scores, at = (np.concatenate(x) for x in zip(kept, (ids, scores, at), strict=True))
    best = np.lexsort((at, ids, -scores))[:most]  # scores stay above -2^62, so the sign can turn
    return ids[best], scores[best], at[best]


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, width)


EMPTY = (np.empty(0, np.int64),) * 3


class _Tile:
    """A block of anchors, and what its heaps hold so far."""

    def __init__(self, rows: pa.Table, width: int):
        self.x = np.ascontiguousarray(_unpacked(rows["packed"].combine_chunks(), width))
        self.at, self.ids, self.labels = (rows[c].to_numpy() for c in ("at", "vec", "label"))
        self.wanted = [np.asarray(w or [], np.int64) for w in rows["wanted"].to_pylist()]
        self.heaps: list[dict] = [{} for _ in self.at]

    def positives(self, ids: np.ndarray, labels: np.ndarray, at: np.ndarray, x: np.ndarray, most: int) -> None:
        scores = strassen(self.x, np.ascontiguousarray(x.T))
        for r, heap in enumerate(self.heaps):
            kept = heap.get(0, EMPTY)
            good = (labels == self.labels[r]) & (at != self.at[r])
            if len(kept[0]) == most:
                good &= scores[r] >= kept[1][-1]
            if len(c := np.flatnonzero(good)):
                heap[0] = merged(kept, ids[c], scores[r, c], at[c], most)

    def negatives(self, ids: np.ndarray, labels: np.ndarray, at: np.ndarray, x: np.ndarray, most: int) -> None:
        scores = strassen(self.x, np.ascontiguousarray(x.T))
        for r, heap in enumerate(self.heaps):
            wanted = self.wanted[r]
            wanted = wanted[wanted >= 0]  # a negative score's window is empty
            if not len(wanted):
                continue
            low, high = -(-50 * wanted // 100), 95 * wanted // 100
            c = np.flatnonzero((scores[r] >= low.min()) & (scores[r] <= high.max()) & (labels != self.labels[r]))
            if not len(c):
                continue
            s = scores[r, c]
            order = np.lexsort((at[c], ids[c], -s))
            c, s = c[order], s[order]
            begin, end = np.searchsorted(-s, -high, "left"), np.searchsorted(-s, -low, "right")
            for w, b, e in zip(wanted.tolist(), begin.tolist(), np.minimum(end, begin + most).tolist(), strict=True):
                if b < e:
                    heap[w] = merged(heap.get(w, EMPTY), ids[c[b:e]], s[b:e], at[c[b:e]], most)

    def rows(self) -> Iterator[tuple]:
        for anchor, heap in zip(self.at.tolist(), self.heaps, strict=True):
            for wanted, (ids, scores, at) in heap.items():
                for row in zip(ids.tolist(), scores.tolist(), at.tolist(), strict=True):
                    yield (anchor, wanted, *row)


FOUND = pa.schema([(c, pa.int64()) for c in ("anchor", "wanted", "vec", "score", "at")])
FOUND_SCHEMA = "anchor long, wanted long, vec long, score long, at long"


def _meet(batches: Iterator[pa.RecordBatch], step: str, most: int, candidates: int) -> Iterator[pa.RecordBatch]:
    """Rows of the heaps of each unit. Its rows come one after the other, anchors (side 0) first; candidates stream by."""
    tile, unit, held, n = None, None, [], 0

    def flush() -> None:
        nonlocal held, n
        if held and tile is not None:
            rows = pa.Table.from_batches(held)
            getattr(tile, step)(*(rows[c].to_numpy() for c in ("vec", "label", "at")), _unpacked(rows["packed"].combine_chunks(), unit[0]), most)
        held, n = [], 0

    def found() -> Iterator[pa.RecordBatch]:
        flush()
        rows = list(tile.rows()) if tile is not None else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FOUND)

    anchors: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("width", "i", "j", "side")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            if b == e:
                continue
            here, side = tuple(keys[:3, b].tolist()), keys[3, b]
            if here != unit:
                yield from found()
                tile, unit, anchors = None, here, []
            if side == 0:
                anchors.append(batch.slice(b, e - b))
                continue
            if anchors:
                tile, anchors = _Tile(pa.Table.from_batches(anchors), unit[0]), []
            if tile is None:
                continue  # candidates whose anchors' block is empty
            for k in range(b, e, candidates):
                part = batch.slice(k, min(candidates, e - k))
                held.append(part)
                n += part.num_rows
                if n >= candidates:
                    flush()
    yield from found()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of 32-bit numbers, which hold them: their squared length is below 2^62."""
    for b in batches:
        x = b.column("x")
        values, ends = x.flatten().to_numpy().astype("<i4"), np.cumsum(b.column("width").to_numpy())
        packed = [values[s:e].tobytes() for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)] if len(ends) else []
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("vec", "label", "width")] + [pa.array(packed, pa.binary())], ["vec", "label", "width", "packed"])


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Heaps of all tasks merged: an array of (order, vec, score, at) of at most ``most`` rows for each of ``keys``."""
    one = F.struct((-F.col("score")).alias("order"), "vec", "at", "score")
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(one)), 1, most).alias("best"))


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: Callable[[Column], Column] = lambda i: i % 50 == 0,
    relabel: Callable[[Column, Column], Column] = lambda i, label: label, positives: int = 5, negatives: int = 3, anchors: int = ANCHORS, candidates: int = CANDIDATES, splits: int = SPLITS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best negatives for each anchor and positive.

    A component counts as floor(256 * x). An anchor's positives are its ``positives`` best other rows of the same
    label; for each, the ``negatives`` best rows of other labels with a score from 50 % to 95 % of the positive's.
    Higher scores come first, ties by smaller id.

    Every anchor meets every row, in blocks: that is the query set against all rows, not a join of pairs.
    ``anchors`` rows are a block, which meets the candidates in ``splits`` tasks; a task holds one tile of scores
    and the heaps of its block, and returns the heaps alone. Positives come first, from the candidates that share
    a bucket of labels with the block, so this pass is short; windows need the positives' scores and are the
    second. A frequent label is many blocks of anchors, each dealt over ``splits`` tasks.

    Defined cases: rows with a null label, id or vector, with no components, or with a null or non-finite one take
    no part, nor do those whose scaled vector has a squared length of 2^62 or more, since a score could leave the
    range of a long; only vectors of equal length meet; rows that repeat an id take part each, and as anchors
    give their rows each; a positive with a score of 0 finds negatives with 0, one below finds none; an
    empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    vec, vector = F.col(id_col).cast("long"), F.col(vector_col)
    numbers = vectors.select(vec.alias("vec"), relabel(vec, F.col(label_col)).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < 2.0**30) & ~F.isnan(x), F.lit(False))) & (F.size("v") > 0)
    numbers = numbers.where("vec is not null and label is not null and v is not null").where(fine)
    squared = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ints = numbers.select("vec", "label", F.size("v").alias("width"), F.transform("v", lambda x: F.floor(F.lit(256.0) * x)).alias("x")).where(squared < MOST_SQUARED)
    rows = ints.mapInArrow(_packed, "vec long, label long, width int, packed binary")
    # a number of its own for each row: ids may repeat
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("anchor", is_anchor(F.col("vec"))))

    buckets = min(BUCKETS, max(1, -(-rows.count() // candidates)))
    bucket = F.pmod(F.xxhash64("label", F.lit("bucket")), F.lit(buckets)).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.pmod(F.xxhash64("at", F.lit("split")), F.lit(splits)).cast("int")

    def units(asking: DataFrame, key: Column) -> DataFrame:
        """Rows keyed by (width, i, j, side): blocks of anchors that share ``key``, against all rows that share it, in splits."""
        sizes = asking.groupBy("width", key.alias("key")).agg(F.count("*").alias("n"))
        begin = durable(sizes.withColumn("blocks", F.ceil(F.col("n") / anchors).cast("int")).drop("n"))
        begin = F.broadcast(begin) if begin.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES else begin
        mine = asking.withColumn("key", key).join(begin, ["width", "key"])
        block = F.xxhash64("key", F.pmod(F.xxhash64("at", F.lit("block")), F.col("blocks")).cast("int"))
        left = mine.select("width", block.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("j"), F.lit(0).alias("side"), "vec", "label", "at", "packed", "wanted")
        others = rows.withColumn("key", key).join(begin, ["width", "key"])
        each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", b))
        right = others.select("width", F.explode(each).alias("i"), split.alias("j"), F.lit(1).alias("side"), "vec", "label", "at", "packed", F.lit(None).cast("array<long>").alias("wanted"))
        return left.unionByName(right).repartition(parts, "width", "i", "j").sortWithinPartitions("width", "i", "j", "side")

    asking = rows.where("anchor").withColumn("wanted", F.lit(None).cast("array<long>"))
    found = units(asking, bucket).mapInArrow(lambda it: _meet(it, "positives", positives, candidates), FOUND_SCHEMA)
    chosen = durable(_best(found, ["anchor"], positives).select(F.col("anchor").alias("at"), "best"))

    asking = rows.where("anchor").join(chosen.select("at", F.array_distinct("best.score").alias("wanted")), "at")
    found = units(asking, F.lit(0)).mapInArrow(lambda it: _meet(it, "negatives", negatives, candidates), FOUND_SCHEMA)
    windows = _best(found, ["anchor", "wanted"], negatives)

    pairs = chosen.join(rows.where("anchor").select("at", F.col("vec").alias("anchor_id")), "at").select("at", "anchor_id", F.explode("best").alias("p"))
    pairs = pairs.select("at", "anchor_id", F.col("p.vec").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = pairs.join(windows, (F.col("at") == F.col("anchor")) & (F.col("positive_score") == F.col("wanted")))
    ranked = out.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "b"))
    return ranked.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
