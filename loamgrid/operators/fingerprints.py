"""A digest of a corpus that follows every change and no way of dealing the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between fields, and in place of a null.
FIELD, NULL = "\x1f", "\x1a"


def record_digests(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, digest): SHA-256 of a record's id and fields as text, with the unit separator between them and a mark for null."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in (key, *columns)]
    return df.select(F.col(key).alias("id"), F.sha2(F.encode(F.concat_ws(FIELD, *fields), "UTF-8"), 256).alias("digest"))


def corpus_fingerprint(df: DataFrame, key: str, columns: list[str], depth: int = 4) -> DataFrame:
    """One row (n, digest): the root of a tree of digests over all records.

    A record lies in the leaf named by the first ``depth`` hex digits of its id's SHA-256. A leaf's digest is the SHA-256
    of its records' digests in the order of their ids (then digests) one after the other; a node's is that of its
    children's names and digests in order, ``name:digest`` joined by commas, up to the root, whose name is empty.
    So no group gathers more than a leaf's share (records / 16^depth) or 16 children, order and repeats count, and the
    same records give the same digest under any partitioning. Without records the digest is that of the empty text.
    """
    leaf = F.substring(F.sha2(F.encode(F.coalesce(F.col("id").cast("string"), F.lit(NULL)), "UTF-8"), 256), 1, depth)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda r: r["digest"]), "")
    level = record_digests(df, key, columns).groupBy(leaf.alias("node")).agg(F.count("*").alias("n"), F.sha2(joined.cast("binary"), 256).alias("digest"))
    for k in range(depth - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda r: F.concat(r["node"], F.lit(":"), r["digest"])), ",")
        up = F.substring("node", 1, k) if k else F.lit("")
        level = level.groupBy(up.alias("up")).agg(F.sum("n").alias("n"), F.sha2(children.cast("binary"), 256).alias("digest")).withColumnRenamed("up", "node")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))
