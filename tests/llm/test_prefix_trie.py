import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loamgrid.llm.prefix_trie import NODE, Skeleton, chosen_splitters, prefix_trie, rebuilt_paths

SCHEMA = "conv_id long, turn long, role string, text string, words string"


def plain(rows):
    """The contract with sets of beginnings."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        children = lambda q: [k for k in nodes if len(k) == len(q) + 1 and k[: len(q)] == q]
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((len(p), min(members), min(nodes[p[:-1]]) if p else None, len(members), len(children(p)), sum(not children(q) for q in below), saved, digest))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in prefix_trie(df, **how).select(NODE).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = []
    for c in range(0, 230):
        for t in range(c % 5 + (c % 7 == 0)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of kind {c % 3 if t < 2 else c % 11}", "x"))
    return out + [(c, t, "user", f"the same {t}", "x") for c in range(300, 420) for t in range(3)]  # copies


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_against_plain(spark, rows, shards):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, shards=shards) == plain(rows)


def test_cut_splitters(spark):
    rows = [(c, t, "u", f"t{t} {'x' if t < 5 else c % 4}", "x") for c in range(60) for t in range(8)]
    assert found(spark.createDataFrame(rows, SCHEMA), shards=9, deepest=2) == plain(rows)


def test_splitters_do_not_depend_on_how_rows_are_dealt(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one, other = (chosen_splitters(rebuilt_paths(df.repartition(n)), 8) for n in (1, 7))
    assert one == other and len(one) == 7 and len(Skeleton(one).up) > 1


def test_defined_cases(spark):
    rows = [(1, None, None, None, "x"), (1, 0, "user", "a  b\tc", "x"), (1, 0, "user", "a  b\tc", "x"), (None, 0, "user", "nobody", "x"), (2, 0, None, "", "x"), (20, 3, "user", "é" * 50_000, "x")]
    rows += [(3, 1, "a", "tie two", "x"), (3, 1, "a", "tie one", "x"), (2**60 + 1, 0, "user", "large", "x"), (2**60 + 2, 0, "user", "large", "x"), (23, 0, "user", "one turn only", "x"), (-3, 0, "user", "below zero", "x")]
    got, want = found(spark.createDataFrame(rows, SCHEMA), shards=3), plain(rows)
    assert [r for r in got if r[1] != 3] == [r for r in want if r[1] != 3] and len(got) == len(want)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    only = [(i, 0, "user", "x", "x") for i in range(41, 44)]  # one own turn, no base: some have no turns at all
    assert found(spark.createDataFrame(only, SCHEMA)) == plain(only)
    assert prefix_trie(spark.createDataFrame(rows, SCHEMA).where(F.lit(False))).columns == NODE
