"""Queries of selection, statistics, periods and stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import temporal as P
from loamgrid.operators import tables as T
from loamgrid.plans.views import area_boxes, read, sql_with


def f01(spark, d):
    """Counts of rows under each comparison, over a column with nulls."""
    c = read(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    tests = {"eq": ("==", 2547.4), "ne": ("!=", 2547.4), "gt": (">", 5000), "ge": (">=", 5000), "lt": ("<", 0), "le": ("<=", 0), "between": ("between", (900, 100)), "isnull": ("isnull", None), "notnull": ("notnull", None)}
    found = c.agg(*[F.count_if(T.predicate(F.col("v"), op, x)).alias(k) for k, (op, x) in tests.items()])
    # a column with some numbers compares as numbers, one without as text, whatever the single cell is
    mixed = c.withColumn("m", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment")))
    for k, column in (("mixed_gt", "m"), ("text_gt", "c_mktsegment")):
        found = found.crossJoin(T.select(mixed, column, ">", 50).agg(F.count("*").alias(k)))
    return found.crossJoin(T.select(mixed, "m", "!=", 50).agg(F.count("*").alias("mixed_ne")))


def f02(spark, d):
    c = read(spark, d, "customer").withColumn("s", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.agg(
        F.count_if(T.predicate(F.col("s"), "in", ["HOUSEHOLD", "BUILDING"])).alias("n_in"), F.count_if(T.predicate(F.col("s"), "not_in", ["HOUSEHOLD", "BUILDING"])).alias("n_not_in"),
        F.count_if(T.predicate(F.col("s"), "contains", "^(mach|auto).*y|e$")).alias("n_contains"), F.count_if(T.predicate(F.col("s"), "==", "MACHINERY")).alias("n_text"),
    )


def f06(spark, d):
    e = read(spark, d, "events").withColumn("at", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    low, high = P.bound(F.lit("2024-01-03"), False), P.bound(F.lit("2024-01-05"), True)
    return e.agg(F.count_if(F.col("at").between(low, high)).alias("inside"), F.count_if(F.col("at").isNull()).alias("unparsed"), F.min(F.when(F.col("at").between(low, high), F.col("at"))).alias("first"))


def f07(spark, d):
    o = read(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.floor(F.col("o_totalprice") / 1000), F.lit(","), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"))))
    n = T.to_number(F.col("price"))
    return o.agg(F.count(n).alias("parsed"), F.count_if(n.isNull()).alias("unparseable"), F.sum(n).alias("total"))


def f08(spark, d):
    p = read(spark, d, "part").withColumn("size", F.when(F.col("p_size") % 4 != 0, F.col("p_size")))
    return p.agg(F.count("*").alias("all_rows"), F.count_if(F.col("size").isNotNull() & F.col("p_retailprice").isNotNull()).alias("usable"))


def f09(spark, d):
    return read(spark, d, "part").where(F.lower("p_type").isin("economy", "standard")).select("p_partkey", "p_type")


def f18(spark, d):
    """Findings about a layer: empty, beyond degrees, flat box, style column with one value."""
    e = area_boxes(spark, d)
    m = e.agg(F.count("*").alias("n"), F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1"), F.count_distinct("region").alias("values"))
    found = F.array_compact(F.array(F.when(F.col("n") == 0, "empty"), F.when((F.col("x0") < -180) | (F.col("x1") > 180) | (F.col("y0") < -90) | (F.col("y1") > 90), "beyond degrees"), F.when((F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1")), "flat"), F.when(F.col("values") == 1, "one value")))
    return m.select("n", "values", F.array_join(found, ",").alias("findings"))


def a05(spark, d):
    out = T.describe(read(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax"))), ["l_quantity", "l_tax", "l_discount"])
    return out.select("column", "count", "missing", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "std", "sum")])


def _rounded(df):
    return df.select("group", "n", *[F.round(c, 7 if c == "mean" else 4).alias(c) for c in ("min", "max", "mean", "median", "std", "sum")])


def a06(spark, d):
    c = read(spark, d, "customer")
    return _rounded(T.summary_by(c, F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")), "c_acctbal"))


def a07(spark, d):
    o = read(spark, d, "orders").withColumn("at", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")))
    return _rounded(T.summary_by(o, P.period_label(F.col("at"), "quarter"), "o_totalprice"))


def a08(spark, d):
    return T.class_breaks(read(spark, d, "lineitem"), "l_quantity", 5).select(F.posexplode("breaks").alias("k", "break_at"))


def a09(spark, d):
    b = area_boxes(spark, d).withColumn("v", F.col("area_id") * 1.5)
    out = T.dissolve(b, "region", {"v": "sum"}, ["area"], "area_id")
    return out.select("region", "feature_count", F.round("v", 6).alias("v"), "area", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def a10(spark, d):
    counted = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")) * 100, 2).alias("percent_high"))
    return T.top_n(counted, "n", 10, "event_type")


def a11(unit):
    return lambda spark, d: T.time_series(read(spark, d, "orders"), "o_orderdate", unit)


def a11_profile(kind):
    return lambda spark, d: T.profile(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", kind)


def a12(spark, d):
    o = T.top_categories(read(spark, d, "orders"), "o_orderpriority", 3)
    wide = o.groupBy(F.year("o_orderdate").alias("year"), "category").agg(F.count("*").alias("n"))
    top = F.sum(F.when(F.col("category") != "other", F.col("n")).otherwise(0))
    return wide.groupBy("year").agg(F.sum("n").alias("total"), top.alias("in_top"), F.sum(F.when(F.col("category") == "other", F.col("n")).otherwise(0)).alias("other"))


def a19(spark, d):
    c = read(spark, d, "customer").withColumn("weight", (F.col("c_custkey") % 9 + 1).cast("long"))
    return T.weighted_median(c, "c_mktsegment", "c_acctbal", "weight")


def a42(spark, d):
    e = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    night = F.hour("at").isin(22, 23, 0, 1, 2, 3, 4, 5)
    return e.groupBy("event_type").agg(F.round(F.avg(night.cast("double")), 6).alias("night_share"), F.count("*").alias("n"))


def t01(spark, d):
    c = read(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return T.top_n(c, "v", 25, "c_custkey").select("c_custkey", "v", F.lit("top").alias("side")).unionByName(T.top_n(c, "v", 25, "c_custkey", True).select("c_custkey", "v", F.lit("bottom").alias("side")))


def d01(spark, d):
    """Dates written three ways; one format is chosen for the column by what it reads."""
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, F.lit("not a date")).when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a")).alias("written"))
    parsed, name = P.parse_text(o, "written")
    return parsed.groupBy(F.lit(name).alias("method"), F.year("parsed").alias("year")).agg(F.count("*").alias("n"))


def d01_numbers(spark, d):
    o = read(spark, d, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    number = F.when(F.col("o_orderkey") % 4 == 0, F.year("o_orderdate").cast("double")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd").cast("double")).when(F.col("o_orderkey") % 4 == 2, seconds.cast("double")).otherwise(seconds * 1000.0)
    return o.select("o_orderkey", P.from_number(number).alias("parsed"))


def d03(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")))
    return o.select("o_orderkey", P.bound(text, False).alias("low"), P.bound(text, True).alias("high"))


def d05(spark, d):
    e = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select("event_id", *[P.period_label(F.col("at"), u).alias(u) for u in P.UNITS])


def d06(spark, d):
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"))
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    both = P.granularity(e, "at").withColumn("table", F.lit("events")).unionByName(P.granularity(o, "at").withColumn("table", F.lit("orders")))
    return both.select("table", "granularity", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def s15(spark, d):
    return T.content_key(read(spark, d, "nation"), "layer", ["n_regionkey", "n_name"]).select("n_nationkey", "key")


def s17(spark, d):
    return T.expired(read(spark, d, "orders"), "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"), "o_orderkey")


def s20(spark, d):
    old = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0))
    return T.replace_by_id(old, new, "c_custkey")


def s21(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    gone = turns.where("conv_id % 6 = 0").select("conv_id").distinct()
    return T.with_tombstones(turns, gone, "conv_id")


def s22(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 8 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return T.fit_to_type(e, "k", "bigint")


def s25(spark, d):
    e = read(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("event_type").alias("types"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def f28(spark, d):
    """Owners whose spend today is at or over their own limit, else the default; unlimited owners never are."""
    e = read(spark, d, "events")
    spent = e.groupBy(F.col("user_id").alias("owner"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("spent"))
    own = e.select(F.col("user_id").alias("owner")).distinct().where("owner % 5 = 0").select("owner", F.when(F.col("owner") % 10 == 0, F.lit(float("inf"))).otherwise(120.0).alias("own"))
    return spent.join(own, "owner", "left").where(F.col("spent") >= F.coalesce("own", F.lit(250.0))).select("owner", "day", "spent")


QUERIES = {
    "f01_compare": f01, "f02_in_and_contains": f02, "f06_filter_by_time": f06, "f07_coerce_numeric": f07, "f08_drop_unusable": f08, "f09_select_rows": f09, "f18_layer_qa": f18, "f28_over_limit": f28,
    "a05_describe": a05, "a06_summary_by": a06, "a07_summary_by_period": a07, "a08_class_breaks": a08, "a09_dissolve": a09, "a10_value_counts": a10, "a11_time_series_month": a11("month"), "a11_time_series_week": a11("week"),
    "a11_profile_hour": a11_profile("hour"), "a11_profile_weekday": a11_profile("weekday"), "a11_profile_month": a11_profile("month"), "a12_time_series_by": a12, "a19_weighted_median": a19, "a42_night_share": a42,
    "t01_top_and_bottom": t01, "d01_parse_text": d01, "d01_parse_numbers": d01_numbers, "d03_period_bounds": d03, "d05_period_labels": d05, "d06_granularity": d06, "s15_content_key": s15, "s17_expired": s17, "s20_upsert": s20,
    "s21_tombstones": s21, "s22_fit_to_schema": s22, "s25_dataset_summary": s25,
}

_STATS = "count(*) AS n, round(min({v}), 4) AS min, round(max({v}), 4) AS max, round(avg({v}), 7) AS mean, round(median({v}), 4) AS median, round(stddev_samp({v}), 4) AS std, round(sum({v}), 4) AS sum"
_COLUMN = "SELECT '{c}' AS \"column\", count({v}) AS count, count(*) - count({v}) AS missing, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS std, round(sum({v}), 6) AS sum FROM lineitem"
_PROFILE = "SELECT k::INT AS slot, count(e.ts) AS n FROM range({low}, {high}) r(k) LEFT JOIN events e ON {part} = k GROUP BY 1"
_SPAN = "SELECT '{t}' AS \"table\", CASE WHEN bool_or(second({c}) <> 0) THEN 'second' WHEN bool_or(minute({c}) <> 0) THEN 'minute' WHEN bool_or(hour({c}) <> 0) THEN 'hour' WHEN bool_or(day({c}) <> 1) THEN 'day' WHEN bool_or(month({c}) <> 1) THEN 'month' ELSE 'year' END AS granularity, min({c}) AS first, max({c}) AS last, count({c}) AS n FROM {t}"
_LABEL = "strftime({c}, '%Y-%m')"

SQL = {
    "f01_compare": "WITH c AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v FROM customer) SELECT count(*) FILTER (v = 2547.4) AS eq, count(*) FILTER (v IS DISTINCT FROM 2547.4) AS ne, count(*) FILTER (v > 5000) AS gt, count(*) FILTER (v >= 5000) AS ge, count(*) FILTER (v < 0) AS lt, count(*) FILTER (v <= 0) AS le, count(*) FILTER (v BETWEEN 100 AND 900) AS between, count(*) FILTER (v IS NULL) AS isnull, count(v) AS notnull, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 50) AS mixed_gt, (SELECT count(*) FROM customer WHERE c_mktsegment > '50') AS text_gt, (SELECT count(*) FROM customer WHERE c_custkey <> 51 - 1 OR c_custkey % 3 <> 0) AS mixed_ne FROM c",
    "f02_in_and_contains": "WITH c AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer) SELECT count(*) FILTER (s IN ('HOUSEHOLD', 'BUILDING')) AS n_in, count(*) FILTER (s IS NULL OR s NOT IN ('HOUSEHOLD', 'BUILDING')) AS n_not_in, count(*) FILTER (regexp_matches(s, '(?i)^(mach|auto).*y|e$')) AS n_contains, count(*) FILTER (s = 'MACHINERY') AS n_text FROM c",
    "f06_filter_by_time": "WITH e AS (SELECT CASE WHEN event_id % 50 <> 0 THEN ts END AS w FROM events) SELECT count(*) FILTER (w >= '2024-01-03' AND w < '2024-01-06') AS inside, count(*) FILTER (w IS NULL) AS unparsed, min(w) FILTER (w >= '2024-01-03' AND w < '2024-01-06') AS first FROM e",
    "f07_coerce_numeric": "SELECT count(*) FILTER (o_orderkey % 9 <> 0) AS parsed, count(*) FILTER (o_orderkey % 9 = 0) AS unparseable, sum(floor(o_totalprice)) FILTER (o_orderkey % 9 <> 0) AS total FROM orders",
    "f08_drop_unusable": "SELECT count(*) AS all_rows, count(*) FILTER (p_size % 4 <> 0) AS usable FROM part",
    "f09_select_rows": "SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN ('economy', 'standard')",
    "f18_layer_qa": sql_with("area_boxes", body=" SELECT count(*) AS n, count(DISTINCT region) AS values, '' AS findings FROM area_boxes"),
    "f28_over_limit": "WITH s AS (SELECT user_id AS owner, ts::DATE AS day, round(sum(value), 6) AS spent FROM events GROUP BY 1, 2) SELECT * FROM s WHERE spent >= CASE WHEN owner % 10 = 0 THEN 'inf'::DOUBLE WHEN owner % 5 = 0 THEN 120 ELSE 250 END",
    "a05_describe": " UNION ALL ".join(_COLUMN.format(c=c, v=v) for c, v in (("l_quantity", "l_quantity"), ("l_tax", "(CASE WHEN l_tax > 0 THEN l_tax END)"), ("l_discount", "l_discount"))),
    "a06_summary_by": "SELECT coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END, '(missing)') AS \"group\", " + _STATS.format(v="c_acctbal") + " FROM customer GROUP BY 1",
    "a07_summary_by_period": "SELECT CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) ELSE '(missing)' END AS \"group\", " + _STATS.format(v="o_totalprice") + " FROM orders GROUP BY 1",
    "a08_class_breaks": "WITH b AS (SELECT DISTINCT round(unnest(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1])), 6) AS break_at FROM lineitem) SELECT (row_number() OVER (ORDER BY break_at) - 1)::INT AS k, break_at FROM b",
    "a09_dissolve": sql_with("area_boxes", body=" SELECT region, count(*) AS feature_count, round(sum(area_id * 1.5::DOUBLE), 6) AS v, arg_min(area, area_id) AS area, round(min(xmin), 6) AS xmin, round(min(ymin), 6) AS ymin, round(max(xmax), 6) AS xmax, round(max(ymax), 6) AS ymax FROM area_boxes GROUP BY 1"),
    "a10_value_counts": "SELECT event_type, count(*) AS n, round(avg((value > 50)::INT) * 100, 2) AS percent_high FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "a11_time_series_month": "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS start, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1, 2",
    "a11_time_series_week": "SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS start, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS label, count(*) AS n FROM orders GROUP BY 1, 2",
    "a11_profile_hour": _PROFILE.format(low=0, high=24, part="hour(e.ts)"),
    "a11_profile_weekday": _PROFILE.format(low=0, high=7, part="isodow(e.ts) - 1"),
    "a11_profile_month": _PROFILE.format(low=1, high=13, part="month(e.ts)"),
    "a12_time_series_by": "WITH t AS (SELECT o_orderpriority AS p FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT year(o_orderdate)::INT AS year, count(*) AS total, count(*) FILTER (o_orderpriority IN (FROM t)) AS in_top, count(*) FILTER (o_orderpriority NOT IN (FROM t)) AS other FROM orders GROUP BY 1",
    "a19_weighted_median": "WITH r AS (SELECT c_mktsegment, c_acctbal, sum(c_custkey % 9 + 1) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) AS upto, sum(c_custkey % 9 + 1) OVER (PARTITION BY c_mktsegment) AS whole FROM customer) SELECT c_mktsegment, min(c_acctbal) AS weighted_median FROM r WHERE upto * 2 >= whole GROUP BY 1",
    "a42_night_share": "SELECT event_type, round(avg((hour(ts) >= 22 OR hour(ts) < 6)::INT), 6) AS night_share, count(*) AS n FROM events GROUP BY 1",
    "t01_top_and_bottom": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS v FROM customer) (SELECT *, 'top' AS side FROM c ORDER BY v DESC NULLS LAST, c_custkey LIMIT 25) UNION ALL (SELECT *, 'bottom' FROM c ORDER BY v ASC NULLS LAST, c_custkey LIMIT 25)",
    "d01_parse_text": "SELECT 'MM/dd/yyyy hh:mm:ss a' AS method, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0 THEN year(o_orderdate) END::INT AS year, count(*) AS n FROM orders GROUP BY 2",
    "d01_parse_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('year', o_orderdate)::TIMESTAMP ELSE o_orderdate END AS parsed FROM orders",
    "d03_period_bounds": "WITH p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('quarter', o_orderdate) END::TIMESTAMP AS low, CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 12 MONTH WHEN 1 THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END AS size FROM orders) SELECT o_orderkey, low, low + size - INTERVAL 1 MICROSECOND AS high FROM p",
    "d05_period_labels": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month, year(ts) || 'Q' || quarter(ts) AS quarter, strftime(ts, '%Y') AS year FROM events",
    "d06_granularity": _SPAN.format(t="events", c="ts") + " UNION ALL " + _SPAN.format(t="orders", c="o_orderdate"),
    "s15_content_key": """SELECT n_nationkey, 'layer-' || substr(sha1('{"n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}'), 1, 10) AS key FROM nation""",
    "s17_expired": "SELECT count(*) AS scanned, count(*) FILTER (o_orderdate < '1997-01-01') AS deleted, coalesce(sum(o_orderkey) FILTER (o_orderdate < '1997-01-01'), 0)::BIGINT AS freed FROM orders",
    "s20_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "s21_tombstones": "SELECT conv_id, turn, role, false AS deleted FROM conversations WHERE conv_id % 6 <> 0 UNION ALL SELECT DISTINCT conv_id, NULL::BIGINT, NULL::VARCHAR, true FROM conversations WHERE conv_id % 6 = 0",
    "s22_fit_to_schema": "SELECT event_id, CASE WHEN event_id % 8 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 8 = 0 THEN event_type END AS k_text FROM events",
    "s25_dataset_summary": "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT event_type) AS types, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events",
}
