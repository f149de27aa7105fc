"""Embedding near duplicates by int8 tile products with error bounds.

Method: unit vectors are quantised to int8 with one scale each; the exact length of what quantising left
over bounds the error of every product. Blocks of vectors meet in tiles; pairs whose int8 product plus
bound could reach the threshold, and no others, are recomputed from the full vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.batches import beside
from loamgrid.llm.ids import named, numbered
from loamgrid.operators.components import connected_components
from loamgrid.plans.durable import durable, evenly

#: Distinct vectors in a block on average; a tile holds two blocks.
BLOCK = 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the error) of each unit row; the error is measured, not assumed."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def close_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold of raw rows ``x`` and ``y`` (or i < j within ``x``), some rows of x at a time.

    For u = s_u q_u + e_u and v likewise: |u.v - s_u s_v q_u.q_v| <= |e_u| |s_v q_v| + |v'| |e_v| with
    |s_v q_v| <= 1 + |e_v| and |v'| <= 1. Integer products stay below 2^24 for up to 1,040 dimensions, so
    float32 carries them exactly; wider vectors are multiplied in float64. A margin of 1e-9 covers rounding.
    """
    # by powers of two, which changes no digit: lengths of 1e200 or 1e-200 would leave the range of a double when squared
    near_one = lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    x, y = near_one(x), None if y is None else near_one(y)
    norm = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    within = y is None
    right = x if within else y
    u, v = norm(x), None
    v = u if within else norm(right)
    (cu, su, eu), (cv, sv, ev) = quantised(u), quantised(v)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    left, table = cu.astype(kind), cv.astype(kind).T
    for k in range(0, len(u), 512):
        product = left[k : k + 512] @ table
        limit = threshold - 1e-9 - eu[k : k + 512, None] * (1 + ev)[None, :] - ev[None, :]
        i, j = np.nonzero(product >= limit / (su[k : k + 512, None] * sv[None, :]) - 1e-3)
        i = i + k
        if within:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        a, b = x[i], right[j]
        cosine = np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))
        yield i[cosine >= threshold], j[cosine >= threshold]


def _tile(rows: pd.DataFrame, threshold: float, kind: type) -> pd.DataFrame:
    """Links of one tile: for each vector the weight of its partners, and the edges of a spanning forest."""
    rows = rows.sort_values(["side", "at"])
    at, copies = rows["at"].to_numpy(), rows["copies"].to_numpy()
    x = np.stack([np.frombuffer(b, kind) for b in rows["packed"]]).astype(np.float64)
    cut = int((rows["side"] == 0).sum())
    within = cut == len(rows)
    links, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in close_pairs(x if within else x[:cut], None if within else x[cut:], threshold):
        b = b if within else b + cut
        links += np.bincount(a, copies[b], len(rows)).astype(np.int64) + np.bincount(b, copies[a], len(rows)).astype(np.int64)
        for i, j in set(zip(parent[a].tolist(), parent[b].tolist(), strict=True)):
            i, j = top(i), top(j)
            parent[max(i, j)] = min(i, j)
    linked = np.flatnonzero(links)
    return pd.DataFrame({"at": at[linked], "links": links[linked], "joined": at[[top(i) for i in linked]]})


def _packed(vectors: list[list | None], kind: type) -> list[list]:
    """Vectors as bytes of their own precision; those that link with nothing get no bytes."""
    out: list[bytes | None] = []
    for v in vectors:
        x = np.asarray([np.nan if e is None else e for e in v], kind) + kind(0) if v is not None and None in v else np.asarray(v if v is not None else (), kind) + kind(0)
        out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
    return [out]


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(id, n_links long, component_id, kept boolean), one row a vector.

    Every pair with cosine >= ``threshold`` in double precision is a link and no other pair is; the search is
    exact. Equal vectors are one row with a count, so a group of copies costs one row and no pairs. Distinct
    vectors are dealt by hash to blocks of about ``block`` and each pair of blocks is one task of bounded
    size; a task returns counts and a spanning forest, never pairs. Vectors travel in the precision of their
    column, not as int8 codes with the full ones fetched afterwards: for that, a tile would have to list its
    uncertain pairs, which in a group of near copies are quadratic.

    Defined cases: null or empty vectors, all zeros, and null or non-finite components link with nothing
    (n_links 0, a component of their own); only vectors of equal length meet; a repeated id takes part with
    each of its vectors and gets one row for each; a null id is counted as a link of others but has component and
    kept null; ids may be of any type that can be ordered; vectors of any length from 1e-300 to 1e300 are compared,
    as each is scaled by a power of two first; an empty table gives an empty table; labels and other columns are ignored.
    """
    rows, names = numbered(vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("vector")), "vec", "vec")
    kind = np.float32 if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    packed = durable(beside(rows, ["vec"], ["vector"], "packed binary", lambda: lambda v: _packed(v, kind)))
    same = packed.where("packed is not null").groupBy("packed").agg(F.min("vec").alias("first"), F.count("*").alias("copies"))
    # a number of its own for each distinct vector: ids may repeat with other vectors
    distinct = durable(same.withColumn("at", F.monotonically_increasing_id()))
    blocks = max(1, -(-distinct.count() // block))
    mine = F.pmod(F.xxhash64("packed"), F.lit(blocks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(mine > o, 1).otherwise(0).alias("side")))
    dealt = distinct.select("at", "copies", "packed", F.octet_length("packed").alias("width"), F.explode(tiles).alias("t")).select("at", "copies", "packed", "width", "t.*")
    found = durable(dealt.groupBy("width", "i", "j").applyInPandas(lambda g: _tile(g, threshold, kind), "at long, links long, joined long"))
    links = evenly(found.groupBy("at").agg(F.sum("links").alias("links")), "at")
    component = connected_components(found.select(F.col("at").alias("src"), F.col("joined").alias("dst")).where("src <> dst"))
    parts = distinct.select("at", "first").join(evenly(component, "node"), F.col("at") == F.col("node"), "left").select("at", "first", F.coalesce("component", "at").alias("part"))
    least = evenly(parts.groupBy("part").agg(F.min("first").alias("component_id")), "part")
    by_vector = distinct.select("at", "packed", "copies").join(links, "at", "left").join(parts.join(least, "part").select("at", "component_id"), "at")
    out = packed.join(evenly(by_vector, "packed"), "packed", "left")
    n_links = F.when(F.col("packed").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    own = F.when(F.col("vec").isNotNull(), F.coalesce("component_id", "vec"))
    out = out.select("vec", n_links.alias("n_links"), own.alias("component_id"), (F.col("vec") == own).alias("kept"))
    return named(out, names, ["vec", "component_id"], "vec").withColumnRenamed("vec", id_col)
