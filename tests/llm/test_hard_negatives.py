import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm.hard_negatives import hard_negatives, merged, strassen

SCHEMA = "vec_id long, embedding array<double>, label int, at string"


def plain(rows, most_positive=5, most_negative=3):
    """The contract, pair by pair."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, v, label) for i, v, label in good if sum(x * x for x in v) < 2**62]
    out = []
    for a, (anchor, v, label) in enumerate(good):
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for b, (i, w, other) in enumerate(good) if b != a and len(w) == len(v))
        for s, positive, _ in [x for x in scored if x[2] == label][:most_positive]:
            window = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(anchor, positive, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(window[:most_negative])]
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 64, 47), (64, 64, 64), (70, 9, 41)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    rng = np.random.default_rng(1)
    for top in (10, 2**20, 2**28):
        a, b = rng.integers(-top, top, (n, k)), rng.integers(-top, top, (k, m))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
        assert strassen(a, b, leaf=8).tolist() == want


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    rows = [(int(i), int(s), k) for k, (i, s) in enumerate(zip(rng.integers(0, 20, 60), rng.integers(0, 5, 60), strict=True))]
    want = [(i, s) for i, s, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:5]]
    for seed in range(3):
        heap = (np.empty(0, np.int64),) * 3
        for part in np.array_split(np.random.default_rng(seed).permutation(60), 7):
            heap = merged(heap, *(np.array([rows[k][c] for k in part], np.int64) for c in range(3)), 5)
        assert list(zip(heap[0].tolist(), heap[1].tolist(), strict=True)) == want


def test_against_every_pair(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), (centres[int(i) % 4] * 0.6 + rng.normal(size=6) * 0.4).tolist(), int(rng.integers(0, 5)), "x") for i in range(300)]
    rows += [(i, rows[7][1], 1, "copy") for i in range(1000, 1120)]  # a hot group with ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block, tile, splits in ((512, 2048, 4), (2, 16, 3)):
        got = sorted(tuple(r) for r in hard_negatives(df, anchors=block, candidates=tile, splits=splits).collect())
        assert got == plain(rows) and len(got) > 50


def test_defined_cases(spark):
    v = [1.0, 2.0, -0.5]
    rows = [(0, v, 1, "a"), (50, v, 1, "a"), (50, v, 1, "a"), (None, v, 1, "a"), (3, None, 1, "a"), (4, [], 1, "a"), (5, [1.0, None, 2.0], 1, "a"), (6, [float("nan"), 1.0, 1.0], 1, "a")]
    rows += [(7, [float("inf"), 1.0, 1.0], 2, "a"), (8, v, None, "a"), (9, [1e300, 1.0, 1.0], 2, "a"), (10, [0.7, 1.4, -0.2], 2, "a"), (11, [0.7, 1.4, -0.2], 3, "a"), (12, [0.5, 1.5], 2, "a"), (100, [0.0, 0.0, 0.0], 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives(df).collect())
    assert got == plain(rows) and {10, 11} <= {r[3] for r in got}
    zero = [(0, [1.0, 0.0], 1, "a"), (1, [0.0, 1.0], 1, "a"), (2, [0.0, 2.0], 2, "a"), (3, [-1.0, 0.0], 2, "a")]
    assert [tuple(r) for r in hard_negatives(spark.createDataFrame(zero, SCHEMA)).collect()] == plain(zero) == [(0, 1, 1, 2, 0, 0)]
    assert hard_negatives(df.where(F.lit(False))).collect() == []
    big = 2**40 + 1
    apart = [(50 * big, v, 1, "a"), (50 * big + 1, v, 1, "a"), (50 * big + 2, [0.7, 1.4, -0.2], 2, "a"), (None, v, 2, "a")]
    assert [r["negative_id"] for r in hard_negatives(spark.createDataFrame(apart, SCHEMA)).collect()] == [50 * big + 2]
