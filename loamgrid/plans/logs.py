"""Queries of usage, traces, ledgers, evaluation and stored records."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from loamgrid.operators import links as K
from loamgrid.operators import logs as L
from loamgrid.operators import lookups as U
from loamgrid.operators import tables as T
from loamgrid.plans.durable import checkpoint_dir, durable
from loamgrid.plans.views import read
from loamgrid.sources.store import RecordStore, fingerprints


def _calls(spark, d):
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.concat(F.when(F.col("event_id") % 3 == 0, "acme/").otherwise(""), F.col("event_type"))
    return e.select("event_id", "user_id", "ts", "event_type", "value", model.alias("model"), k.alias("k"), (k * 100).alias("input_tokens"), (k * 10).alias("output_tokens"), (k * 25).alias("cached"))


def _prices(spark):
    return spark.createDataFrame([("click", 1.5), ("acme/view", 2.0), ("view", 3.0), ("signup", 0.7)], "model string, rate double")


def j30(spark, d):
    return L.price_lookup(_calls(spark, d).select("event_id", "model"), _prices(spark), "model")


def a21(spark, d):
    priced = L.price_lookup(_calls(spark, d), _prices(spark), "model")
    cost = L.call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached"), F.col("rate"), F.col("rate") * 4, F.col("rate") / 10)
    rows = priced.withColumn("cost", cost)
    out = rows.rollup("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.round(F.sum("cost"), 3).alias("cost"), F.count_if(F.col("rate").isNull()).alias("unpriced"))
    return out.withColumn("model", F.coalesce("model", F.lit("(total)")))


def a22(spark, d):
    return L.usage_by_day(_calls(spark, d).withColumn("coins", F.col("k") * 0.01), "user_id", "ts", "value", "coins")


def a23(spark, d):
    return L.trace_summary(read(spark, d, "events"), "user_id", "event_type", "event_id", "props")


def a24(spark, d):
    c = _calls(spark, d)
    return L.scorecard(c, "event_type", F.col("k") > 40, F.col("event_id") % 4 != 0, F.col("k") < 20)


def a25(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    checks = F.array(F.struct(F.lit("symbols").alias("name"), F.contains("text", F.lit("$$$")).alias("fired")), F.struct(F.lit("menu").alias("name"), F.contains("text", F.lit(" | ")).alias("fired")), F.struct(F.lit("shouting").alias("name"), F.contains("text", F.lit("!!")).alias("fired")))
    rows = docs.select("quality", F.explode(checks).alias("c")).select("quality", "c.*")
    return L.check_rates(rows, "name", F.col("fired"), F.col("quality") == 0)


def a28(spark, d):
    c = _calls(spark, d)
    return c.groupBy((F.col("user_id") % 2).alias("arm"), (F.col("event_id") % 3).alias("replicate")).agg(F.count_if(F.col("k") > 30).alias("passed"), F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("degraded"))


def a29(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("p_size") > 40, "too large"), F.when(F.col("p_retailprice") > 1500, "too dear"), F.when(F.col("p_type") == "PROMO", "promoted")))
    return read(spark, d, "part").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def a34(spark, d):
    o = read(spark, d, "orders").withColumn("owner", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")))
    recent = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    return o.agg(F.count("owner").alias("owned"), F.count_if(F.col("owner").isNull()).alias("unowned"), F.count_if(F.col("owner").isNull() & recent).alias("recent_unowned"))


def a44(spark, d):
    r = L.repeats(_calls(spark, d), ["user_id", "event_type", "k"], "event_id")
    failed = F.col("event_type") == "error"
    return r.groupBy("user_id").agg(F.count_if(F.col("before") > 0).alias("repeated"), F.count_if(failed).alias("failed"), F.count_if((F.col("before") > 0) | failed).alias("unproductive"))


def a46(spark, d):
    return U.census(read(spark, d, "documents"), F.col("lang"), F.col("source") == "src0")


def a47(spark, d):
    """Roll-up of claim rows per answer: unseen where a cut is blamed, bad where absent or contradicted."""
    c = _calls(spark, d)
    status = F.when((F.col("event_type") == "error") & (F.col("k") > 80), "unseen").when(F.col("event_type") == "error", "absent").when(F.col("event_type") == "signup", "contradicted").otherwise("supported")
    rows = c.select("user_id", status.alias("status"))
    bad = F.count_if(F.col("status").isin("absent", "contradicted"))
    return rows.groupBy("user_id").agg(bad.alias("bad"), F.count_if(F.col("status") == "unseen").alias("unseen"), F.bool_or(F.col("status") == "supported").alias("any_supported"), F.when(bad == 0, "none").when(bad > F.count("*") * 0.4, "high").otherwise("low").alias("severity"))


def a48(spark, d):
    """Two runs on the keys that both have."""
    c = _calls(spark, d).select((F.col("user_id") % 100).alias("task"), (F.col("event_id") % 2).alias("run"), (F.col("k") > 50).cast("int").alias("ok"))
    base = c.where("run = 0").groupBy("task").agg(F.max("ok").alias("base_ok"))
    new = c.where("run = 1").groupBy("task").agg(F.max("ok").alias("new_ok"))
    return base.join(new, "task").agg(F.count("*").alias("tasks"), F.sum("base_ok").alias("base_ok"), F.sum("new_ok").alias("new_ok"), F.count_if(F.col("base_ok") != F.col("new_ok")).alias("changed"))


def a49(spark, d):
    """Guard of a load against the state that the last one stored: a kind fails whose rows fell over a tenth, or are under a least number."""
    state = RecordStore(spark, posixpath.join(checkpoint_dir(spark), f"loads-{uuid.uuid4().hex}"), "event_type")
    e = read(spark, d, "events")
    loads = [e, e.where("event_id % 8 <> 0 or event_type = 'view'").unionByName(e.where("event_type = 'click'"))]
    out = None
    for rows in loads:
        now = rows.groupBy("event_type").agg(F.count("*").alias("n"))
        if state.versions():
            out = durable(T.shrink_guard(state.read("counts"), now, "event_type", "n", 100))
        state.replace({"counts": now}, fingerprints({"counts": now}, "event_type"))
    return out


def f17(spark, d):
    e = read(spark, d, "events")
    return e.where(F.col("event_type").isin("error", "click") & (F.get_json_object("props", "$.k").cast("int") >= 50)).select("event_id", "event_type", (F.col("event_type") == "error").alias("has_error"))


def f20(spark, d):
    """A layer over the cap keeps the rows that come first by a hash, and says so."""
    e = read(spark, d, "events")
    total = e.count()
    return T.first_by_hash(e.select("event_id"), "event_id", max(1, total // 10)).withColumn("total", F.lit(total))


def f24(spark, d):
    """A stated number is a claim if it has a unit or isn't a small whole number."""
    p = read(spark, d, "part").withColumn("unit", F.when(F.col("p_partkey") % 3 == 0, "km"))
    claim = F.col("unit").isNotNull() | (F.col("p_size") > 12) | (F.col("p_size") != F.floor("p_size"))
    return p.select("p_partkey", claim.alias("is_claim"))


def f29(spark, d):
    """Clauses on a map of tags: a key, key = value, a pattern, a negation."""
    p = read(spark, d, "part").withColumn("tags", F.create_map(F.lit("kind"), F.col("p_type"), F.lit("brand"), F.col("p_brand")))
    return p.where(F.map_contains_key("tags", "kind") & (F.col("tags")["kind"] == "ECONOMY") & F.col("tags")["brand"].rlike("#1") & (F.col("tags")["brand"] != "Brand#11")).select("p_partkey")


def j07(spark, d):
    """Who found a partner by text key, leading zeros kept, and how many did not on either side."""
    a = read(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))
    b = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.lpad((F.col("o_custkey") + 200).cast("string"), 6, "0").alias("key")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "key", "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("joined"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.min(F.when(F.col("a").isNull(), F.col("key"))).alias("example"))


def j08(spark, d):
    """Prefixes to whole ids, where only one id has them."""
    ids = read(spark, d, "part").select(F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("id"))
    keyed = ids.withColumn("prefix", F.substring("id", 1, 3))
    one = keyed.groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return one.select("prefix", "id")


def j10(spark, d):
    """Customers and suppliers that share an author, spelt in several ways; the score is the share of a customer's lines."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pairs = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("shared"))
    total = pairs.groupBy("o_custkey").agg(F.sum("shared").alias("lines"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"))
    spelt = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit(" and  "), F.upper("author"))).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("& "), F.replace("author", F.lit("#"), F.lit("!#")))).otherwise(F.concat("author", F.lit(" , ")))
    specs = pairs.join(s, "l_suppkey").select("o_custkey", spelt.alias("author"))
    scores = pairs.join(total, "o_custkey").select("o_custkey", "l_suppkey", (F.col("shared") / F.col("lines")).alias("score"))
    out = K.shared_author_links(specs, s, scores, "o_custkey", "l_suppkey")
    return out.select("o_custkey", "l_suppkey", F.round("score", 9).alias("score"), F.round("runner_up", 9).alias("runner_up"), "candidates", F.array_join("authors", ",").alias("authors"))


def j18(spark, d):
    """Hits with their parent's name and kind."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    return l.join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey", "left").select("l_orderkey", "p_name", "p_type")


def j20(spark, d):
    """Stored children that the latest run didn't make again."""
    stored = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    made = stored.where("(l_orderkey + l_linenumber) % 5 <> 0")
    return stored.join(made, ["l_orderkey", "l_linenumber"], "left_anti").groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("orphans"))


def j28(spark, d):
    c = _calls(spark, d)
    calls = c.where("event_id % 5 <> 0").select("event_id", F.col("event_type").alias("call"))
    results = c.where("event_id % 7 <> 0").select("event_id", F.col("k").alias("result"))
    return L.pair_calls(calls, results, "event_id")


def j31(spark, d):
    """Orders of a customer gathered in order, with their lines counted."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "orders")


def s16(spark, d):
    p = read(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "PROMO") & F.contains("p_name", F.lit("ring")))
    return p.orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(20).select("p_partkey", "p_name", "p_retailprice")


def s19(spark, d):
    """Rows that break a rule of the record tables, one count a rule."""
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.agg(F.count_if(~((F.col("l_returnflag") == "A") | (F.col("l_tax") < 0.08))).alias("tax_rule"), F.count_if(F.col("l_suppkey") == F.col("l_partkey")).alias("self_link"), F.count_if(~F.col("l_linestatus").isin("O", "F")).alias("status_rule"))


def s23(spark, d):
    return T.schema_drift(read(spark, d, "orders"), {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)", "o_clerk": "string", "o_orderdate": "timestamp"})


def t07(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))
    return c.where("conv_id % 2 = 0").orderBy(F.desc("turns"), "conv_id").limit(50)


def u03(spark, d):
    known = read(spark, d, "orders").select("o_custkey").distinct()
    made = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return known.exceptAll(made)


def u01(spark, d):
    """Two arms one after the other, each item where it came first."""
    e = read(spark, d, "events")
    arm = lambda kind, n: e.where(F.col("event_type") == kind).select((F.col("user_id") % 20).alias("case_id"), F.col("user_id").alias("item"), F.lit(n).alias("arm"), F.col("event_id").alias("pos"))
    return T.keep_first(arm("click", 1).unionByName(arm("view", 2)), ["case_id", "item"], ["arm", "pos"])


def u04(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split("p_name", " "), F.array(F.lit("ring"), F.lit("red"), F.lit("small")))), ",").alias("shared"))


def w11(spark, d):
    c = _calls(spark, d).withColumn("size", F.col("k"))
    return L.newest_within_budget(c, "user_id", "event_type", "event_id", "size", 4, 12, 400).select("user_id", "event_id", "upto")


def w12(spark, d):
    return L.last_n(read(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "age")


def w16(spark, d):
    out = L.memo_hit(_calls(spark, d), "user_id", ["event_type", "k"], "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("event_id", "world_no", "memo")


def w17(spark, d):
    """Whether a row's content is new to the log."""
    e = read(spark, d, "events").select("event_id", F.sha1(F.concat_ws("|", "event_type", "props").cast("binary")).alias("digest"))
    first = e.groupBy("digest").agg(F.min("event_id").alias("first"))
    return e.join(first, "digest").select("event_id", (F.col("event_id") == F.col("first")).alias("is_new"))


def c07(spark, d):
    """Three runs of each user's figures by kind, against one another."""
    e = _calls(spark, d).groupBy("event_type", "user_id", (F.col("event_id") % 3).alias("run")).agg(F.round(F.avg("value"), 6).alias("v"))
    return L.disagreements(e, "event_type", "run", "v", "user_id", 0.2)


def c08(spark, d):
    stated = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    facts = read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return L.resolve_numbers(stated, facts, "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", 5.0)


def c10(spark, d):
    """Texts of a conversation in order, as one digest."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.size("t").alias("blocks"), F.md5(F.encode(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), "UTF-8")).alias("digest"))


QUERIES = {
    "a21_usage_by_model": a21, "a22_usage_by_day": a22, "a23_trace_summary": a23, "a24_scorecard": a24, "a25_check_rates": a25, "a28_ab_report": a28, "a29_blocked_by": a29, "a34_ownership": a34, "a44_repeated_calls": a44, "a46_census": a46,
    "a47_claim_verdict": a47, "a48_compare_runs": a48, "a49_shrink_guard": a49, "c07_disagreements": c07, "c08_resolve_numbers": c08, "c10_block_documents": c10, "f17_filter_trace": f17, "f20_cap_for_map": f20, "f24_numeric_claim": f24,
    "f29_tag_filter": f29, "j07_join_report": j07, "j08_prefix_join": j08, "j10_margin_links": j10, "j18_parent_resolve": j18, "j20_orphans": j20, "j28_pair_calls": j28, "j30_price_lookup": j30, "j31_browser": j31, "s16_find_files": s16,
    "s19_rule_breaks": s19, "s23_schema_drift": s23, "t07_list_memories": t07, "u01_union_arms": u01, "u03_known_minus_made": u03, "u04_term_overlap": u04, "w11_newest_within_budget": w11, "w12_last_n": w12, "w16_memo_hit": w16, "w17_is_new_content": w17,
}

_CALLS = "c AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'acme/' ELSE '' END || event_type AS model, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"
_RATE = "CASE model WHEN 'click' THEN 1.5 WHEN 'acme/click' THEN 1.5 WHEN 'acme/view' THEN 2.0 WHEN 'view' THEN 3.0 WHEN 'signup' THEN 0.7 WHEN 'acme/signup' THEN 0.7 END::DOUBLE"

SQL = {
    "j30_price_lookup": f"WITH {_CALLS} SELECT event_id, model, {_RATE} AS rate FROM c",
    "a21_usage_by_model": f"WITH {_CALLS}, p AS (SELECT *, {_RATE} AS rate FROM c), q AS (SELECT *, (k * 75 * rate + k * 25 * (rate / 10) + k * 10 * (rate * 4)) / 1e6 AS cost FROM p) SELECT coalesce(model, '(total)') AS model, count(*) AS calls, sum(k * 100)::BIGINT AS input, sum(k * 10)::BIGINT AS output, round(sum(cost), 3) AS cost, count(*) FILTER (rate IS NULL) AS unpriced FROM q GROUP BY ROLLUP (model)",
    "a22_usage_by_day": f"WITH {_CALLS} SELECT user_id, ts::DATE AS day, count(*) AS turns, round(sum(value), 6) AS usd, round(sum(k * 0.01::DOUBLE), 6) AS coins, round(sum(value) + sum(k * 0.01::DOUBLE), 6) AS credits FROM c GROUP BY 1, 2",
    "a23_trace_summary": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("error", "click", "view", "purchase", "signup")) + ", arg_min(props, event_id) FILTER (event_type = 'click') AS first_route, arg_max(props, event_id) FILTER (event_type = 'view') AS last_answer FROM events GROUP BY 1",
    "a24_scorecard": f"WITH {_CALLS} SELECT event_type, count(*) AS tasks, count(*) FILTER (event_id % 4 <> 0) AS solvable, count(*) FILTER (event_id % 4 <> 0 AND k > 40) AS correct, count(*) FILTER (event_id % 4 = 0 AND k < 20) AS refused, round(avg((CASE WHEN event_id % 4 <> 0 THEN k > 40 ELSE k < 20 END)::INT), 6) AS strict FROM c GROUP BY 1",
    "a25_check_rates": "WITH r AS (SELECT quality, unnest([{'name': 'symbols', 'fired': contains(text, '$$$')}, {'name': 'menu', 'fired': contains(text, ' | ')}, {'name': 'shouting', 'fired': contains(text, '!!')}], recursive := true) FROM documents JOIN labels USING (doc_id)) SELECT name, count(*) FILTER (fired AND quality <> 0) AS on_right, count(*) FILTER (fired AND quality = 0) AS on_wrong, round(count(*) FILTER (fired AND quality = 0) / nullif(count(*) FILTER (fired), 0), 6) AS precision, round(count(*) FILTER (fired AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 6) AS recall FROM r GROUP BY 1",
    "a28_ab_report": f"WITH {_CALLS} SELECT user_id % 2 AS arm, event_id % 3 AS replicate, count(*) FILTER (k > 30) AS passed, count(*) AS total, count(*) FILTER (event_type = 'error') AS degraded FROM c GROUP BY 1, 2",
    "a29_blocked_by": "SELECT unnest(list_filter([CASE WHEN p_size > 40 THEN 'too large' END, CASE WHEN p_retailprice > 1500 THEN 'too dear' END, CASE WHEN p_type = 'PROMO' THEN 'promoted' END], lambda x: x IS NOT NULL)) AS reason, count(*) AS n FROM part GROUP BY 1",
    "a34_ownership": "SELECT count(*) FILTER (o_custkey % 4 <> 0) AS owned, count(*) FILTER (o_custkey % 4 = 0) AS unowned, count(*) FILTER (o_custkey % 4 = 0 AND o_orderdate >= '1999-01-01') AS recent_unowned FROM orders",
    "a44_repeated_calls": f"WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY event_id) > 1 AS again FROM c) SELECT user_id, count(*) FILTER (again) AS repeated, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (again OR event_type = 'error') AS unproductive FROM r GROUP BY 1",
    "a46_census": "SELECT lang, count(*) AS n FROM documents WHERE source IS DISTINCT FROM 'src0' GROUP BY 1",
    "a47_claim_verdict": f"WITH {_CALLS}, r AS (SELECT user_id, CASE WHEN event_type = 'error' AND k > 80 THEN 'unseen' WHEN event_type = 'error' THEN 'absent' WHEN event_type = 'signup' THEN 'contradicted' ELSE 'supported' END AS s FROM c), g AS (SELECT user_id, count(*) FILTER (s IN ('absent', 'contradicted')) AS bad, count(*) FILTER (s = 'unseen') AS unseen, bool_or(s = 'supported') AS any_supported, count(*) AS n FROM r GROUP BY 1) SELECT user_id, bad, unseen, any_supported, CASE WHEN bad = 0 THEN 'none' WHEN bad > n * 0.4 THEN 'high' ELSE 'low' END AS severity FROM g",
    "a48_compare_runs": f"WITH {_CALLS}, r AS (SELECT user_id % 100 AS task, max((k > 50)::INT) FILTER (event_id % 2 = 0) AS b, max((k > 50)::INT) FILTER (event_id % 2 = 1) AS n FROM c GROUP BY 1) SELECT count(*) AS tasks, sum(b)::BIGINT AS base_ok, sum(n)::BIGINT AS new_ok, count(*) FILTER (b <> n) AS changed FROM r WHERE b IS NOT NULL AND n IS NOT NULL",
    "a49_shrink_guard": "WITH g AS (SELECT event_type, count(*) AS before, count(*) FILTER (event_id % 8 <> 0 OR event_type = 'view') + count(*) FILTER (event_type = 'click') AS now FROM events GROUP BY 1) SELECT *, now < before * 0.9 OR now < 100 AS fails FROM g",
    "c07_disagreements": f"WITH {_CALLS}, e AS (SELECT event_type AS name, user_id AS input, event_id % 3 AS run, round(avg(value), 6) AS v FROM c GROUP BY 1, 2, 3) SELECT a.name, a.input, a.run AS run_a, a.v AS value_a, b.run AS run_b, b.v AS value_b FROM e a JOIN e b ON a.name = b.name AND a.input = b.input AND a.run < b.run WHERE abs(a.v - b.v) > 0.2::DOUBLE * greatest(abs(a.v), abs(b.v))",
    "c08_resolve_numbers": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 5.0",
    "c10_block_documents": "SELECT conv_id, count(*)::INT AS blocks, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "f17_filter_trace": "SELECT event_id, event_type, event_type = 'error' AS has_error FROM events WHERE event_type IN ('error', 'click') AND json_extract_string(props, '$.k')::INT >= 50",
    "f20_cap_for_map": "SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT (SELECT count(*) // 10 FROM events)",
    "f24_numeric_claim": "SELECT p_partkey, p_partkey % 3 = 0 OR p_size > 12 AS is_claim FROM part",
    "f29_tag_filter": "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND contains(p_brand, '#1') AND p_brand <> 'Brand#11'",
    "j07_join_report": "WITH a AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS key, 1 AS a FROM customer), b AS (SELECT DISTINCT lpad((o_custkey + 200)::VARCHAR, 6, '0') AS key, 1 AS b FROM orders WHERE o_orderkey % 3 = 0) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS joined, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, min(key) FILTER (a IS NULL) AS example FROM a FULL JOIN b USING (key)",
    "j08_prefix_join": "SELECT substr(md5(p_partkey::VARCHAR), 1, 3) AS prefix, min(md5(p_partkey::VARCHAR)) AS id FROM part GROUP BY 1 HAVING count(*) = 1",
    "j10_margin_links": "WITH p AS (SELECT o_custkey, l_suppkey, count(*) AS shared FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), q AS (SELECT *, shared / sum(shared) OVER (PARTITION BY o_custkey) AS score FROM p), r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS second, count(*) OVER (PARTITION BY o_custkey) AS candidates FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, l_suppkey DESC)) SELECT o_custkey, l_suppkey, round(score, 9) AS score, round(second, 9) AS runner_up, candidates, replace(lower(s_name), '#', '') AS authors FROM r JOIN supplier ON s_suppkey = l_suppkey WHERE n = 1 AND score >= 0.05 AND second <= score * 0.8::DOUBLE",
    "j18_parent_resolve": "SELECT l_orderkey, p_name, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    "j20_orphans": "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey % 100 AS bucket, count(*) AS orphans FROM s WHERE (l_orderkey + l_linenumber) % 5 = 0 GROUP BY 1",
    "j28_pair_calls": f"WITH {_CALLS} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS call, CASE WHEN event_id % 7 <> 0 THEN k END AS result FROM c WHERE event_id % 5 <> 0 OR event_id % 7 <> 0",
    "j31_browser": "SELECT c_custkey, c_name, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "s16_find_files": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND contains(p_name, 'ring') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20",
    "s19_rule_breaks": "SELECT count(*) FILTER (NOT (l_returnflag = 'A' OR l_tax < 0.08)) AS tax_rule, count(*) FILTER (l_suppkey = l_partkey) AS self_link, count(*) FILTER (l_linestatus NOT IN ('O', 'F')) AS status_rule FROM lineitem",
    "s23_schema_drift": "WITH live AS (SELECT column_name AS field, CASE column_type WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS live FROM (DESCRIBE orders)), x AS (SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_totalprice', 'decimal(12,2)'), ('o_clerk', 'string'), ('o_orderdate', 'timestamp')) t(field, expected)) SELECT field, expected, live FROM x LEFT JOIN live USING (field) WHERE live IS DISTINCT FROM expected",
    "t07_list_memories": "SELECT conv_id, max(turn) AS turns, count(*) FILTER (role = 'user') AS asked FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1 ORDER BY turns DESC, conv_id LIMIT 50",
    "u01_union_arms": "WITH u AS (SELECT user_id % 20 AS case_id, user_id AS item, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS arm, event_id AS pos FROM events WHERE event_type IN ('click', 'view')) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY case_id, item ORDER BY arm, pos) = 1",
    "u03_known_minus_made": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "u04_term_overlap": "SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(p_name, ' '), ['ring', 'red', 'small'])), ',') AS shared FROM part",
    "w11_newest_within_budget": f"WITH {_CALLS}, t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 4), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM t QUALIFY n <= 12), r AS (SELECT *, (sum(k) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM l) SELECT user_id, event_id, upto FROM r WHERE upto <= 400 OR n = 1",
    "w12_last_n": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INT AS age FROM conversations QUALIFY age <= 3",
    "w16_memo_hit": f"WITH {_CALLS}, s AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS world_no FROM c) SELECT event_id, world_no, coalesce(lag(world_no) OVER w = world_no AND lag(event_type) OVER w <> 'error', false) AS memo FROM s WINDOW w AS (PARTITION BY user_id, event_type, k ORDER BY event_id)",
    "w17_is_new_content": "SELECT event_id, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) = 1 AS is_new FROM events",
}
