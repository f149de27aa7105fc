"""Knowledge records: links, ranked lists with quotas, catalogue scores, merged specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import temporal
from loamgrid.functions import text as X
from loamgrid.functions.geo import box_iou


def period_range(written: Column) -> tuple[Column, Column]:
    """(start, end) of one period or of two with a separator between; swapped ends are put right."""
    parts = F.split(written, r"\s*(?:\.\.|/|\bto\b|\buntil\b|–|—)\s*")
    first, last = parts[0], F.element_at(parts, -1)
    a, b = temporal.bound(first, False), temporal.bound(last, False)
    return F.least(a, b), F.greatest(temporal.bound(first, True), temporal.bound(last, True))


def iso_date(written: Column) -> Column:
    return F.nullif(F.regexp_extract(written, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def split_name(name: Column) -> tuple[Column, Column]:
    """(first, last) of a name: the first word and all after it."""
    trimmed = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.regexp_extract(trimmed, r"^(\S+)", 1), F.regexp_extract(trimmed, r"^\S+\s+(.+)$", 1)


def agrees(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers are the same within a share of the larger."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def catalogue_score(terms: list[str], title: Column, abstract: Column, keywords: Column, box: tuple[Column, ...], asked: tuple[Column, ...], licence: Column) -> Column:
    """2 a term in the title, 1 in the abstract, 0.5 in the keywords, 0.75 for a box that meets the one asked for, its overlap, 0.2 for a licence."""
    hit = lambda c, w: sum((X.term_hit(F.lit(t), c).cast("double") * w for t in terms), F.lit(0.0))
    iou = box_iou(box, asked)
    return hit(title, 2.0) + hit(abstract, 1.0) + hit(keywords, 0.5) + F.when(iou > 0, 0.75).otherwise(0.0) + iou + F.when(licence.isNotNull(), 0.2).otherwise(0.0)


def floor_promote(ranked: DataFrame, key: str, kind: str, score: str, item: str, size: int, favoured: str) -> DataFrame:
    """``size`` rows a key by score, at least half of them of the favoured kind where there are that many."""
    by_kind = Window.partitionBy(key, kind).orderBy(F.desc(score), item)
    in_kind = ranked.withColumn("of_kind", F.row_number().over(by_kind))
    first = ((F.col(kind) == favoured) & (F.col("of_kind") <= (size + 1) // 2)).cast("int")
    place = Window.partitionBy(key).orderBy(first.desc(), F.desc(score), item)
    kept = in_kind.withColumn("n", F.row_number().over(place)).where(F.col("n") <= size)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))).select(key, item, kind, score, "rank")


def collapse_shared(units: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """The best row of units that share a name and signature, with how many share it."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return units.withColumn("siblings", F.count("*").over(Window.partitionBy(*keys))).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def merge_specs(steps: DataFrame, doc: str, order: str, step: str) -> DataFrame:
    """Distinct steps of a document in order, white space and case aside."""
    key = F.lower(F.trim(F.regexp_replace(step, r"\s+", " ")))
    first = steps.withColumn("key", key).where("key <> ''").groupBy(doc, "key").agg(F.min(F.struct(order, step)).alias("f"))
    return first.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f[step]).alias("steps"))


def merge_params(parts: DataFrame, doc: str, order: str, params: str) -> DataFrame:
    """(doc, params): for each parameter of a document's parts the value of the first part that names it."""
    each = parts.select(doc, order, F.explode(params).alias("name", "value"))
    first = each.groupBy(doc, "name").agg(F.min_by("value", order).alias("value"))
    return first.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(params))


def graph_score(clicks: Column, degree: Column) -> Column:
    return F.log10(clicks + 1) * 0.3 + F.coalesce(degree, F.lit(0)) * 0.05


def weighted_fulltext(docs: DataFrame, item: str, fields: dict[str, float], stems: list[str]) -> DataFrame:
    """(item, score): the best weight of a field that holds each stem, summed over stems; any stem is enough."""
    score = F.lit(0.0)
    for stem in stems:
        hits = [F.when(X.term_hit(F.lit(stem), F.col(name)), weight).otherwise(0.0) for name, weight in fields.items()]
        score = score + (F.greatest(*hits) if len(hits) > 1 else hits[0])
    return docs.select(item, score.alias("score")).where("score > 0")
