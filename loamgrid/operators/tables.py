"""Tables: selection with the reference semantics of null, statistics, periods, top rows, fitting to a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loamgrid.functions import temporal

MISSING = "(missing)"


def reads_as_number(df: DataFrame, column: str) -> bool:
    """Whether any cell of a column reads as a number; a numeric column needs no look, another one is one aggregate row."""
    if isinstance(df.schema[column].dataType, NumericType):
        return True
    return bool(df.agg(F.max(F.col(column).cast("string").try_cast("double").isNotNull())).first()[0])


def select(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    """Rows that pass a selection test, compared as numbers or as text for the whole column (see ``predicate``)."""
    ordered = op in ("==", "!=", ">", ">=", "<", "<=")
    return df.where(predicate(F.col(column), op, value, not ordered or reads_as_number(df, column)))


def predicate(column: Column, op: str, value=None, numeric: bool = True) -> Column:
    """A selection test. ``!=`` and ``not_in`` keep nulls; the others never do.

    Ordering and equality compare as numbers where the value is one and the column holds any (``numeric``): cells of
    it that are none then pass ``!=`` alone. In a column without numbers, and with other values, they compare as text;
    ``contains`` is a case-insensitive regular expression; ``between`` sorts its bounds and includes both.
    """
    if op in ("isnull", "notnull"):
        return column.isNull() if op == "isnull" else column.isNotNull()
    text = column.cast("string")
    if op in ("in", "not_in"):
        hit = text.isin(*[str(v) for v in value])
        return F.coalesce(hit, F.lit(False)) if op == "in" else F.coalesce(~hit, F.lit(True))
    if op == "contains":
        return F.coalesce(text.rlike(f"(?i){value}"), F.lit(False))
    number = text.try_cast("double")
    if op == "between":
        low, high = sorted(value)
        return F.coalesce(number.between(float(low), float(high)), F.lit(False))
    left, right = text, F.lit(str(value))
    if numeric:
        try:
            left, right = number, F.lit(float(value))
        except (TypeError, ValueError):
            pass
    if op == "!=":
        return ~F.coalesce(left.eqNullSafe(right), F.lit(False))
    test = {"==": left == right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def to_number(column: Column) -> Column:
    """A number from text with thousands separators; null where there is none."""
    return F.regexp_replace(F.trim(column.cast("string")), ",", "").try_cast("double")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, missing, min, max, mean, median, sample std (null under two values), sum. One pass."""
    made = []
    for c in columns:
        n = F.col(c).cast("double")
        made += [F.count(n), F.count("*") - F.count(n), F.min(n), F.max(n), F.avg(n), F.median(n), F.stddev_samp(n), F.sum(n)]
    names = ("count", "missing", "min", "max", "mean", "median", "std", "sum")
    wide = df.agg(*[m.alias(f"{names[k % 8]}_{k // 8}") for k, m in enumerate(made)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{k}").alias(n) for n in names]) for k, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def summary_by(df: DataFrame, by: Column, value: str) -> DataFrame:
    """Statistics of a column per group; the null group is named."""
    return df.groupBy(F.coalesce(by.cast("string"), F.lit(MISSING)).alias("group")).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.sum(value).alias("sum"),
    )


#: Parts of column names that speak of time.
TIME_NAMES = ("date", "time", "year", "month", "day", "created", "updated", "timestamp")


def time_columns(df: DataFrame, sample: int = 4000, least: float = 0.6, most: int = 6) -> DataFrame:
    """(column, rows, parsed_rows, parse_rate, name_suggests_time, rank) of the columns that read as times, best first.

    Looks at ``sample`` rows, as a guess is all that is asked for. Times and texts are tried; numbers, and
    texts that hold only numbers, only under a name that speaks of time. All formats of all columns are counted
    in one pass; one row reaches the driver. Ties go to columns with such a name, then to the earlier.
    """
    rows = df.limit(sample)
    tries: dict[str, list[Column]] = {}
    numeric: dict[str, Column] = {}
    for c, kind in df.dtypes:
        hint = any(h in c.lower() for h in TIME_NAMES)
        if kind.startswith("timestamp") or kind == "date":
            tries[c] = [F.col(c)]
        elif kind == "string":
            text = F.col(c)
            tries[c] = [temporal.iso(text), *[temporal.in_years(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz")) for f in temporal.FORMATS]]
            if not hint:
                numeric[c] = F.count(to_number(text)) == F.count(text)
        elif hint and kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or hint and kind.startswith("decimal"):
            tries[c] = [temporal.from_number(F.col(c))]
    spark = df.sparkSession
    schema = "column string, rows long, parsed_rows long, parse_rate double, name_suggests_time boolean, rank int"
    if not tries:
        return spark.createDataFrame([], schema)
    names = list(tries)
    counted = rows.agg(F.count("*").alias("n"), *[F.greatest(F.lit(0), *map(F.count, tries[c])).alias(f"p{k}") for k, c in enumerate(names)], *[v.alias(f"x{names.index(c)}") for c, v in numeric.items()]).first()
    found = []
    for k, c in enumerate(names):
        rate = counted[f"p{k}"] / counted["n"] if counted["n"] else 0.0
        if rate >= least and counted[f"p{k}"] and not (c in numeric and counted[f"x{k}"]):
            found.append((c, counted["n"], counted[f"p{k}"], rate, any(h in c.lower() for h in TIME_NAMES)))
    found.sort(key=lambda r: (-r[3], not r[4]))
    return spark.createDataFrame([(*r, k + 1) for k, r in enumerate(found[:most])], schema)


def class_breaks(df: DataFrame, column: str, classes: int) -> DataFrame:
    """One row with the distinct quantile breaks from the least to the largest value, rounded to 6."""
    at = F.array(*[F.lit(k / classes) for k in range(classes + 1)])
    return df.agg(F.array_distinct(F.transform(F.percentile(column, at), lambda x: F.round(x, 6))).alias("breaks"))


def top_categories(df: DataFrame, by: str, n: int) -> DataFrame:
    """``df`` with ``category``: the ``n`` most frequent values of a column, ties by name, all others "other".

    The kept list is at most ``n`` rows, so it is broadcast.
    """
    named = df.withColumn("category", F.coalesce(F.col(by).cast("string"), F.lit(MISSING)))
    top = named.groupBy("category").count().orderBy(F.desc("count"), "category").limit(n).select("category", F.lit(True).alias("kept"))
    return named.join(F.broadcast(top), "category", "left").withColumn("category", F.when(F.col("kept"), F.col("category")).otherwise("other")).drop("kept")


def time_series(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Rows per observed period, with its start and label."""
    at = F.col(ts)
    return df.where(at.isNotNull()).groupBy(temporal.period_start(at, unit).alias("start"), temporal.period_label(at, unit).alias("label")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, ts: str, kind: str) -> DataFrame:
    """Rows per hour of the day, day of the week (Monday 0) or month, every slot present."""
    slot, low, high = {"hour": (F.hour(ts), 0, 23), "weekday": (F.weekday(ts), 0, 6), "month": (F.month(ts), 1, 12)}[kind]
    all_slots = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("slot"))
    counted = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    return all_slots.join(counted, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def dissolve(df: DataFrame, by: str, numeric: dict[str, str], first: list[str], order: str) -> DataFrame:
    """One row a group: the box about its boxes, each numeric column by a statistic, others from the first row by ``order``."""
    made = {
        "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
        "first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order),
    }
    return df.groupBy(by).agg(
        F.count("*").alias("feature_count"), *[made[s](c).alias(c) for c, s in numeric.items()], *[F.min_by(c, order).alias(c) for c in first],
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def top_n(df: DataFrame, column: str, n: int, tie: str, ascending: bool = False) -> DataFrame:
    at = F.col(column)
    return df.orderBy(at.asc_nulls_last() if ascending else at.desc_nulls_last(), tie).limit(n)


def replace_by_id(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``new`` in place of those with the same key; the latest copies only."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def with_tombstones(df: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of deleted keys vanish; a row with nothing but the key and a mark stays for each."""
    live = df.join(deleted.select(key), key, "left_anti").withColumn("deleted", F.lit(False))
    marks = deleted.select(key).distinct().withColumn("deleted", F.lit(True))
    return live.unionByName(marks, allowMissingColumns=True)


def fit_to_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The column as ``kind``; what doesn't fit goes to <column>_text as text."""
    fitted = F.col(column).try_cast(kind)
    return df.withColumn(f"{column}_text", F.when(fitted.isNull(), F.col(column).cast("string"))).withColumn(column, fitted)


def schema_drift(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(field, expected, live) of the expected fields whose live type differs or that aren't there; live is null for the latter."""
    live = dict(df.dtypes)
    rows = [(f, kind, live.get(f)) for f, kind in expected.items() if live.get(f) != kind]
    return df.sparkSession.createDataFrame(rows, "field string, expected string, live string")


def content_key(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """A column ``key``: the kind and the first ten digits of the SHA-1 of the row's inputs as JSON with sorted names."""
    inputs = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]))
    return df.withColumn("key", F.concat(F.lit(f"{kind}-"), F.substring(F.sha1(F.encode(inputs, "UTF-8")), 1, 10)))


def expired(df: DataFrame, ts: str, cutoff: Column, size: str) -> DataFrame:
    """One row: rows scanned, rows older than the cutoff, and the bytes they would free."""
    old = F.col(ts) < cutoff
    return df.agg(F.count("*").alias("scanned"), F.count_if(old).alias("deleted"), F.coalesce(F.sum(F.when(old, F.col(size))), F.lit(0)).alias("freed"))


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_by_hash(df: DataFrame, key: str, cap: int) -> DataFrame:
    """The ``cap`` rows that come first by a hash of ``key`` (ties by ``key``), which must be unique.

    Counts of the 65,536 beginnings of the hash tell which of them stay whole; only the rows of the one
    that the cap cuts are ranked, so there is no global sort.
    """
    marked = df.withColumn("__hash", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("__part", F.substring("__hash", 1, 4))
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)  # over at most 65,536 counts
    parts = marked.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(run))
    open_parts = parts.where(F.col("__upto") - F.col("__n") < cap)
    kept = marked.join(F.broadcast(open_parts), "__part")
    cut = kept.where(F.col("__upto") > cap).withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__hash", key)))
    first = cut.where(F.col("__rank") <= F.lit(cap) - F.col("__upto") + F.col("__n"))
    return kept.where(F.col("__upto") <= cap).select(df.columns).unionByName(first.select(df.columns))


def weighted_median(df: DataFrame, by: str, value: str, weight: str, buckets: int = 1024) -> DataFrame:
    """(by, weighted_median): the smallest value up to which half of a group's weight lies; null values and weights don't count.

    Equal values are summed first. Weights of ``buckets`` ranges of a group's values find the range that
    holds the median, and only its values are sorted, so no task sorts a whole group.
    """
    per = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    ends = per.groupBy(F.col("g").alias("eg")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("whole"))
    place = (F.col("v") - F.col("lo")).cast("double") / F.nullif((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0))
    placed = per.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", "w", "whole", F.least(F.lit(buckets - 1), F.floor(F.coalesce(place, F.lit(0.0)) * buckets)).alias("b"))
    upto = lambda o: F.sum("w").over(Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
    sums = placed.groupBy("g", "whole", "b").agg(F.sum("w").alias("w")).withColumn("upto", upto("b"))
    at = sums.where((F.col("upto") * 2 >= F.col("whole")) & ((F.col("upto") - F.col("w")) * 2 < F.col("whole"))).select(F.col("g").alias("h"), F.col("b").alias("c"), (F.col("upto") - F.col("w")).alias("before"))
    inside = placed.join(at, F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("c"))).withColumn("upto", upto("v") + F.col("before"))
    return inside.where(F.col("upto") * 2 >= F.col("whole")).groupBy(F.col("g").alias(by)).agg(F.min("v").alias("weighted_median"))


def shrink_guard(before: DataFrame, now: DataFrame, key: str, n: str, least: int, most_lost: float = 0.1) -> DataFrame:
    """(key, before, now, fails): groups of an earlier state whose rows fell by more than ``most_lost``, or are under ``least``; a group that is gone has 0."""
    old = before.select(key, F.col(n).alias("before"))
    out = old.join(now.select(key, F.col(n).alias("now")), key, "left").na.fill(0, ["now"])
    return out.withColumn("fails", (F.col("now") < F.col("before") * (1 - most_lost)) | (F.col("now") < least))
