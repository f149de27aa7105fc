"""Queries of records, links, catalogues and small scalar rules."""

from __future__ import annotations

import posixpath
import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import geo
from loamgrid.functions import text as X
from loamgrid.operators import links as L
from loamgrid.operators import lookups as U
from loamgrid.operators import records as K
from loamgrid.operators import retrieval as R
from loamgrid.operators import spatial as S
from loamgrid.operators.pairs import dealt
from loamgrid.plans import retrieval as Q
from loamgrid.plans import views as V
from loamgrid.plans.durable import checkpoint_dir, durable
from loamgrid.plans.views import read
from loamgrid.sources.store import RecordStore, changed, fingerprints


def d04(spark, d):
    o = read(spark, d, "orders")
    year, month = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM")
    written = F.when(F.col("o_orderkey") % 3 == 0, year).when(F.col("o_orderkey") % 3 == 1, F.concat(month, F.lit(" .. "), year)).otherwise(F.concat(F.lit("2003 to "), month))
    low, high = K.period_range(written)
    return o.select("o_orderkey", low.alias("low"), high.alias("high"))


def d07(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("soon")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00Z"))).alias("w"))
    return o.select("o_orderkey", K.iso_date(F.col("w")).alias("day"))


def m03(spark, d):
    return read(spark, d, "part").select("p_partkey", X.term_hit(F.lit("widget"), F.col("p_name")).alias("hit"), X.term_hit(F.lit("wid"), F.col("p_name")).alias("part_hit"))


def m20(spark, d):
    first, last = K.split_name(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   "))))
    return read(spark, d, "part").select("p_partkey", first.alias("first"), last.alias("last"))


def g05(spark, d):
    """A square of two kilometres about each site on the Mercator plane."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    west, south = geo.from_mercator(x - 1000, y - 1000)
    east, north = geo.from_mercator(x + 1000, y + 1000)
    return V.site_points(spark, d).select("site_id", *[F.round(c, 7).alias(n) for n, c in (("west", west), ("south", south), ("east", east), ("north", north))])


def g06(spark, d):
    p = V.area_boxes(spark, d)
    box, asked = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), tuple(map(F.lit, (-87.5, 41.3, -87.2, 41.7)))
    licence = F.when(F.col("area_id") % 2 == 0, F.lit("open"))
    s = K.catalogue_score(["nation"], F.replace("area", F.lit("_"), F.lit(" ")), F.when(F.col("region") == 1, "nation borders").otherwise("none"), F.lit("a b"), box, asked, licence)
    return p.select("area_id", F.round(s, 9).alias("score"))


def g09(spark, d):
    p = read(spark, d, "part")
    source, target = F.when(F.col("p_partkey") % 3 == 0, "km").when(F.col("p_partkey") % 3 == 1, "ft").otherwise("kg"), F.lit("mi")
    return p.select("p_partkey", F.round(geo.convert_length(F.col("p_size").cast("double"), source, target), 9).alias("miles"))


def g10(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", K.agrees(F.col("p_retailprice"), F.round("p_retailprice", -1), 0.004).alias("agrees"))


def r02(spark, d):
    """Units have four fields of falling weight, blocks three; a stem counts in the best field that holds it."""
    p = read(spark, d, "part").withColumn("price", F.concat(F.lit("price "), F.floor("p_retailprice"), F.lit(" red promo")))
    units = K.weighted_fulltext(p, "p_partkey", {"p_name": 1.0, "p_type": 0.5, "p_brand": 0.25, "price": 0.125}, ["widget", "promo", "red"])
    blocks = K.weighted_fulltext(p, "p_partkey", {"p_type": 1.0, "p_name": 0.4, "price": 0.2}, ["ring", "economy", "price"])
    return units.withColumn("kind", F.lit("unit")).unionByName(blocks.withColumn("kind", F.lit("block")))


def r06(spark, d):
    """Keyword and vector arms of the same items, fused: an item's vector is the one with its id, as a document's is."""
    hits = Q.r01(spark, d).select("item_id", "doc_id", F.lit("keyword").alias("arm"), "rank")
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    items = read(spark, d, "benchmark").select("item_id").join(v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")
    found = R.knn(items, v.join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), "item_id", "q", "vec_id", "embedding", 10)
    near = found.select("item_id", F.col("vec_id").alias("doc_id"), F.lit("semantic").alias("arm"), F.round("cosine", 6).alias("cosine"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "doc_id"))).drop("cosine")
    both = hits.unionByName(ranked)
    return both.groupBy("item_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(60) + F.col("rank"))), 9).alias("fused"), F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("arms"))


def f10(spark, d):
    shown = F.coalesce(F.lower(F.trim(F.when(F.col("p_partkey") % 5 == 0, " Public ").when(F.col("p_partkey") % 5 == 1, "unlisted").when(F.col("p_partkey") % 5 == 2, "private"))), F.lit("public"))
    return read(spark, d, "part").where(~shown.isin("private", "unlisted")).select("p_partkey")


def f11(spark, d):
    """A category stands for several kinds; a kind stands for itself."""
    p, kinds = read(spark, d, "part"), {"cheap": ["ECONOMY", "STANDARD"], "dear": ["PROMO"]}
    each = [U.category_filter(p, "p_type", k, kinds).groupBy(F.lit(k).alias("asked"), "p_type").agg(F.count("*").alias("n")) for k in ("cheap", "Dear", " economy ")]
    return reduce(lambda a, b: a.unionByName(b), each)


def f26(spark, d):
    """Causes of findings that events stand for: the check by kind of event, the message by its number."""
    k = F.get_json_object("props", "$.k").cast("int")
    check = F.when(F.col("event_type") == "error", "gate:count_population").when(F.col("event_type") == "click", "gate:declared_units").when(F.col("event_type") == "view", "gate:projected_crs").when(F.col("event_type") == "signup", "gate:coverage").otherwise("peer")
    message = F.when(k % 4 == 0, "it exceeds every frame").when(k % 4 == 1, "a fractional count").when(k % 4 == 2, "if g.area > 0: print(g)").otherwise("print(x) of an unrecognised unit")
    return read(spark, d, "events").groupBy(U.finding_cause(check, message).alias("cause")).agg(F.count("*").alias("n"))


def w07(spark, d):
    return K.collapse_shared(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey", "p_retailprice").select("p_partkey", "p_name", "p_brand", "siblings")


def w08(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 40).alias("case_id"), "event_type", "value", "event_id")
    return K.floor_promote(e, "case_id", "event_type", "value", "event_id", 8, "purchase")


def t02(spark, d):
    c = read(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"))
    return c.where("clicks > 0").orderBy(F.desc("clicks"), "user_id").limit(30)


def t03(spark, d):
    e = read(spark, d, "events")
    per = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_distinct("event_type").alias("degree"))
    return per.select("user_id", F.round(K.graph_score(F.col("clicks"), F.col("degree")), 9).alias("score"))


def t04(spark, d):
    """A part's lines are its clicks and its suppliers its neighbours."""
    use = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("clicks"), F.count_distinct("l_suppkey").alias("degree"))
    return U.keyword_graph_rank(read(spark, d, "part"), "p_partkey", "p_name", "p_type", use, ["red", "ring", "promo"]).withColumn("score", F.round("score", 9))


def _dealt_records(spark, d):
    """(orders, lines) with their customer as element_id: joined once, dealt by customer and stored, so what is counted or replaced by customer stays where it is."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("element_id"), "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    i = o.select("element_id", "year", F.col("o_orderkey").alias("l_orderkey")).join(lines, "l_orderkey")
    return durable(dealt(o, "element_id")), durable(dealt(i, "element_id"))


def _record_tables(customers, orders, lines, first_year=None):
    """Eight tables of what belongs to each customer, from all orders or from those since a year."""
    c = customers.withColumnRenamed("c_custkey", "element_id")
    o, i = (rows if first_year is None else rows.where(F.col("year") >= first_year) for rows in (orders, lines))
    counted = lambda rows, *by: rows.groupBy("element_id", *by).agg(F.count("*").alias("n"))
    return {
        "element": c.select("element_id", "c_name", "c_mktsegment"), "unit": i.select("element_id", "l_orderkey", "l_linenumber", "l_partkey"),
        "block": counted(i, "l_returnflag"), "dataset_file": o.select("element_id", "o_orderkey", "o_totalprice"), "dataset_outcome": counted(o, "o_orderstatus"),
        "publication": counted(o, "year"), "spec_link": counted(i, "l_suppkey"), "ingest_run": counted(o),
    }


def s18(spark, d):
    """Eight record tables under one version: all written, a tenth of the elements replaced as units, some removed; both versions' counts."""
    store = RecordStore(spark, posixpath.join(checkpoint_dir(spark), f"records-{uuid.uuid4().hex}"), "element_id")
    customers, (orders, lines) = read(spark, d, "customer"), _dealt_records(spark, d)
    tables = _record_tables(customers, orders, lines)
    first = store.replace_all(tables)
    later = {t: rows.where("element_id % 10 = 0") for t, rows in _record_tables(customers, orders, lines, 1995).items()}
    store.replace(later, changed(store, fingerprints(later, "element_id")))
    store.remove(customers.select(F.col("c_custkey").alias("element_id")).where("element_id % 97 = 5"))
    store.compact()
    both = store.counts(first["version"]).withColumn("at", F.lit("first")).unionByName(store.counts().withColumn("at", F.lit("last")))
    return both.select("at", "table_name", "n_rows", "n_parents")


def j09(spark, d):
    """Rows whose text names another row's DOI."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("10.1234/P"), F.col("p_partkey")).alias("doi"), F.concat(F.lit("cites https://doi.org/10.1234/P"), (F.col("p_partkey") * 7) % 2500, F.lit(", and 10.1234/p"), F.col("p_partkey"), F.lit(".")).alias("body"))
    return U.cited_doi_links(p.withColumnRenamed("p_partkey", "element"), p.withColumnRenamed("p_partkey", "spec"), "element", "body", "spec", "doi", X.dois(F.col("body")))


def j17(spark, d):
    """Raster cells to zones by the centre of the cell."""
    centre = V.pixels(spark, d).select("prow", "pcol", "value", (F.lit(-88) + (F.col("pcol") + 0.5) / 100).alias("lon"), (F.lit(41) + (F.col("prow") + 0.5) / 100).alias("lat"))
    return S.points_in_boxes(centre, V.area_boxes(spark, d), 0.2).groupBy("area_id").agg(F.count("*").alias("cells"), F.round(F.avg("value"), 6).alias("mean"))


def j19(spark, d):
    """Documents with the labels of theirs folded on, copies folded first."""
    docs = read(spark, d, "documents").select("doc_id", "lang")
    labels = read(spark, d, "labels")
    folded = labels.unionByName(labels).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(folded, "doc_id", "left")


def j23(spark, d):
    """Orders by part of a customer's name; a third of the customers isn't public."""
    people = read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    found = U.author_lookup(read(spark, d, "orders"), people, "o_custkey", "c_name", "007", F.col("o_custkey") % 3 != 0, F.col("o_totalprice"))
    return found.select("o_orderkey", "c_name", F.round("score", 9).alias("score"))


def j24(spark, d):
    """Five lookups in one pass over parts: by organisation (the brand), tag, type, relation (parts of one order with part 7) and collection; a tag adds 1.5."""
    p = read(spark, d, "part")
    l = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    with_it = l.where("l_partkey = 7").select("l_orderkey").distinct()
    near = l.join(with_it, "l_orderkey", "left_semi").where("l_partkey <> 7").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("near")).distinct()
    finds = {"organization": F.col("p_brand") == "Brand#3", "tag": F.exists(F.split("p_name", " "), lambda t: t == "small"), "type": F.col("p_type") == "PROMO", "related": F.col("near"), "collection": F.col("p_partkey") % 100 < 10}
    found = U.lookups(p.join(near, "p_partkey", "left"), finds, {"tag": 1.5}, names="found_by")
    return found.select("p_partkey", "score", F.array_join("found_by", ",").alias("found_by"))


def j29(spark, d):
    """Tools that suppliers name, whole or in brackets, as units: the parts' names joined by underscores, of which some are ambiguous or aliases."""
    units = read(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"), (F.col("p_partkey") % 5 == 0).alias("ambiguous"), (F.col("p_partkey") % 7 == 0).alias("alias"))
    s = read(spark, d, "supplier")
    tools = F.array(F.lit("Red Widget (small ring)"), F.lit("abc"), F.lit("lib.module.Small Bolt(x)"), F.concat(F.lit("tool "), F.col("s_suppkey")), F.lit("data"))
    return U.spec_unit_links(s.withColumn("tools", tools), units, "s_suppkey", "tools", "p_partkey", "symbol", F.col("ambiguous"), F.col("alias"))


def a45(spark, d):
    """Steps and parameters of conversations: a step said again counts once, a parameter has its first value."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Load  "), F.upper(F.col("role")))).otherwise(F.concat(F.lit("load "), F.col("role"))).alias("step"), F.create_map(F.col("role"), F.col("turn").cast("string"), F.concat(F.lit("p"), F.col("turn") % 3), F.length("text").cast("string")).alias("params"))
    steps = K.merge_specs(c, "conv_id", "turn", "step").join(K.merge_params(c, "conv_id", "turn", "params"), "conv_id")
    shown = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return steps.select("conv_id", F.array_join("steps", "|").alias("steps"), shown.alias("params"))


def a50(spark, d):
    """What an answer is made of: kinds, unnamed rows, repeated names."""
    p = read(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")))
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("unnamed"), (F.count("name") - F.count_distinct("name")).alias("repeated"))


def a51(spark, d):
    """Brands behind each customer's orders: an order was derived from the one of half its number, returned lines are failed calls."""
    o = read(spark, d, "orders")
    derived = o.where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 2).alias("dst"))
    brands = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand", "l_returnflag")
    return L.sources_used(o.select("o_custkey", "o_orderkey"), derived, brands, "o_custkey", "o_orderkey", "p_brand", F.col("l_returnflag") == "R")


def a52(spark, d):
    n = read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("pixels"))
    return n.agg(F.min("pixels").alias("least"), F.median("pixels").alias("median"), F.max("pixels").alias("most"))


def u07(spark, d):
    """Whether two days saw any user in common: one row a day and user is made first, and meets the next day's."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    days = e.select("day").distinct()
    after = e.select(F.date_sub("day", 1).alias("day"), "user_id")
    shared = e.join(after, ["day", "user_id"]).select("day").distinct().withColumn("comparable", F.lit(True))
    both = days.join(days.select(F.date_sub("day", 1).alias("day")), "day", "left_semi")
    return both.join(shared, "day", "left").select("day", F.coalesce("comparable", F.lit(False)).alias("comparable"))


def c06(spark, d):
    return U.themes_grounded(read(spark, d, "documents"), "source", "text", ["ofthe", "tion", "ning", "zzz"])


def c11(spark, d):
    """Printed figures that equal a measurement, or only after degrees were read as metres."""
    s = V.site_points(spark, d).withColumn("printed", F.when(F.col("site_id") % 3 == 0, F.col("balance")).when(F.col("site_id") % 3 == 1, F.col("balance") * 111_320).otherwise(F.col("balance") + 77))
    same = F.abs(F.col("printed") - F.col("balance")) <= F.abs(F.col("balance")) * 1e-6
    scaled = F.abs(F.col("printed") / 111_320 - F.col("balance")) <= F.abs(F.col("balance")) * 1e-6
    return s.select("site_id", F.when(same, "measured").when(scaled, "degrees as metres").otherwise("unmatched").alias("verdict"))


QUERIES = {
    "a45_method_spec_merge": a45, "a50_answer_diagnostics": a50, "a51_sources_used": a51, "a52_zone_support": a52, "c06_themes_grounded": c06, "c11_printed_vs_measured": c11, "d04_period_range": d04, "d07_iso_date": d07, "f10_visibility": f10,
    "f11_category": f11, "f26_finding_cause": f26, "g05_mercator_square": g05, "g06_catalogue_score": g06, "g09_unit_convert": g09, "g10_agrees_within": g10, "j09_cited_dois": j09, "j17_zonal_join": j17, "j19_attach_record": j19, "j23_author_lookup": j23,
    "j24_lookups": j24, "j29_spec_to_unit": j29, "m03_term_hit": m03, "m20_split_name": m20, "r02_weighted_fulltext": r02, "r06_all_arms": r06, "s18_record_tables": s18, "t02_by_popularity": t02, "t03_graph_score": t03, "t04_keyword_graph_rank": t04,
    "u07_disjoint_runs": u07, "w07_collapse_shared": w07, "w08_floor_promote": w08,
}

_MERC = "6378137.0::DOUBLE * ln(tan(0.7853981633974483 + radians(lat) / 2))"
_BACK = "round(degrees(2 * atan(exp(({y}) / 6378137.0::DOUBLE)) - 1.5707963267948966), 7)"
_R05 = Q.SQL["r05_knn_search"]

_S18_TABLES = {
    "element": "SELECT c_custkey AS e FROM customer", "unit": "SELECT e FROM i", "block": "SELECT DISTINCT e, l_returnflag FROM i", "dataset_file": "SELECT e FROM o", "dataset_outcome": "SELECT DISTINCT e, o_orderstatus FROM o",
    "publication": "SELECT DISTINCT e, y FROM o", "spec_link": "SELECT DISTINCT e, l_suppkey FROM i", "ingest_run": "SELECT DISTINCT e FROM o",
}
_S18 = " UNION ALL ".join(
    f"SELECT * FROM (WITH o AS (SELECT *, o_custkey AS e, year(o_orderdate) AS y FROM orders WHERE {when}), i AS (SELECT e, lineitem.* FROM o JOIN lineitem ON l_orderkey = o_orderkey) SELECT '{at}' AS at, '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT e) AS n_parents FROM ({body}) WHERE {alive})"
    for at, when, alive in (("first", "true", "true"), ("last", "o_custkey % 10 <> 0 OR year(o_orderdate) >= 1995", "e % 97 <> 5"))
    for t, body in _S18_TABLES.items()
)

def _held(column: str, stem: str) -> str:
    return f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}]){stem}(s|es|ing|ed)?($|[^\\p{{L}}\\p{{N}}])')"


def _best_fields(kind: str, fields: dict[str, float], stems: tuple[str, ...]) -> str:
    score = " + ".join("greatest(" + ", ".join(f"CASE WHEN {_held(c, t)} THEN {w} ELSE 0 END" for c, w in fields.items()) + ")" for t in stems)
    return f"SELECT p_partkey, ({score})::DOUBLE AS score, '{kind}' AS kind FROM p"


_R02 = "WITH p AS (SELECT *, 'price ' || floor(p_retailprice)::BIGINT || ' red promo' AS price FROM part), s AS (" + _best_fields("unit", {"p_name": 1.0, "p_type": 0.5, "p_brand": 0.25, "price": 0.125}, ("widget", "promo", "red"))
_R02 += " UNION ALL " + _best_fields("block", {"p_type": 1.0, "p_name": 0.4, "price": 0.2}, ("ring", "economy", "price")) + ") SELECT * FROM s WHERE score > 0"

SQL = {
    "a45_method_spec_merge": "WITH s AS (SELECT conv_id, turn, role, length(text) AS chars, CASE WHEN turn % 2 = 0 THEN 'Load  ' || upper(role) ELSE 'load ' || role END AS step FROM conversations), f AS (SELECT conv_id, lower(regexp_replace(step, '\\s+', ' ', 'g')) AS key, min(turn) AS turn, arg_min(step, turn) AS step FROM s GROUP BY 1, 2), n AS (SELECT conv_id, turn, role AS name, turn::VARCHAR AS v FROM s UNION ALL SELECT conv_id, turn, 'p' || turn % 3, chars::VARCHAR FROM s), p AS (SELECT conv_id, name, arg_min(v, turn) AS v FROM n GROUP BY 1, 2), q AS (SELECT conv_id, string_agg(name || '=' || v, ',' ORDER BY name) AS params FROM p GROUP BY 1), t AS (SELECT conv_id, string_agg(step, '|' ORDER BY turn) AS steps FROM f GROUP BY 1) SELECT * FROM t JOIN q USING (conv_id)",
    "a50_answer_diagnostics": "SELECT p_type, count(*) AS n, count(*) FILTER (p_partkey % 6 = 0) AS unnamed, count(*) FILTER (p_partkey % 6 <> 0) - count(DISTINCT p_name) FILTER (p_partkey % 6 <> 0) AS repeated FROM part GROUP BY 1",
    "a51_sources_used": "WITH RECURSIVE r(o_custkey, node) AS (SELECT o_custkey, o_orderkey FROM orders UNION SELECT r.o_custkey, r.node // 2 FROM r JOIN orders o ON o.o_orderkey = r.node WHERE r.node > 0) SELECT DISTINCT o_custkey, p_brand FROM r JOIN lineitem ON l_orderkey = node JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'",
    "a52_zone_support": "WITH n AS (SELECT label, count(*) AS pixels FROM embeddings GROUP BY 1) SELECT min(pixels) AS least, median(pixels) AS median, max(pixels) AS most FROM n",
    "c06_themes_grounded": "WITH s AS (SELECT source, (max(contains(lower(text), 'ofthe')::INT) + max(contains(lower(text), 'tion')::INT) + max(contains(lower(text), 'ning')::INT) + max(contains(lower(text), 'zzz')::INT)) / 4.0::DOUBLE AS share FROM documents GROUP BY 1) SELECT source, round(share, 6) AS share, share >= 0.7 AS grounded FROM s",
    "c11_printed_vs_measured": "WITH s AS (SELECT s_suppkey AS site_id, s_acctbal AS b, CASE s_suppkey % 3 WHEN 0 THEN s_acctbal WHEN 1 THEN s_acctbal * 111320 ELSE s_acctbal + 77 END AS printed FROM supplier) SELECT site_id, CASE WHEN abs(printed - b) <= abs(b) * 1e-6 THEN 'measured' WHEN abs(printed / 111320 - b) <= abs(b) * 1e-6 THEN 'degrees as metres' ELSE 'unmatched' END AS verdict FROM s",
    "d04_period_range": "WITH p AS (SELECT o_orderkey, date_trunc('year', o_orderdate)::TIMESTAMP AS y, date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN y WHEN 1 THEN y ELSE least(m, '2003-01-01'::TIMESTAMP) END AS low, CASE o_orderkey % 3 WHEN 2 THEN greatest(m + INTERVAL 1 MONTH, '2004-01-01'::TIMESTAMP) ELSE y + INTERVAL 1 YEAR END - INTERVAL 1 MICROSECOND AS high FROM p",
    "d07_iso_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "f10_visibility": "SELECT p_partkey FROM part WHERE p_partkey % 5 NOT IN (1, 2)",
    "f11_category": "SELECT asked, p_type, count(*) AS n FROM part, (VALUES ('cheap', 'ECONOMY'), ('cheap', 'STANDARD'), ('Dear', 'PROMO'), (' economy ', 'ECONOMY')) t(asked, kind) WHERE upper(p_type) = kind GROUP BY 1, 2",
    "f26_finding_cause": "WITH e AS (SELECT event_type AS t, json_extract_string(props, '$.k')::INT % 4 AS k FROM events) SELECT CASE WHEN t = 'error' THEN CASE WHEN k = 0 THEN 'a count that isn''t of rows' ELSE 'count check: other' END WHEN t = 'click' THEN CASE k WHEN 1 THEN 'a mean read as a count' WHEN 3 THEN 'a unit not in the vocabulary' ELSE 'declared unit missing or unparseable' END WHEN t = 'view' THEN CASE k WHEN 2 THEN 'a test for non-zero size' WHEN 3 THEN 'a printed size' ELSE 'a metric operation on a geographic CRS' END WHEN t = 'signup' THEN 'another gate' ELSE 'unattributed' END AS cause, count(*) AS n FROM e GROUP BY 1",
    "g05_mercator_square": V.sql_with("site_points", body=f", m AS (SELECT site_id, 6378137.0::DOUBLE * radians(lon) AS x, {_MERC} AS y FROM site_points) SELECT site_id, round(degrees((x - 1000) / 6378137.0::DOUBLE), 7) AS west, {_BACK.format(y='y - 1000')} AS south, round(degrees((x + 1000) / 6378137.0::DOUBLE), 7) AS east, {_BACK.format(y='y + 1000')} AS north FROM m"),
    "g06_catalogue_score": V.sql_with("area_boxes", body=", i AS (SELECT *, greatest(0, least(xmax, -87.2) - greatest(xmin, -87.5)) * greatest(0, least(ymax, 41.7) - greatest(ymin, 41.3)) AS n FROM area_boxes), j AS (SELECT *, n / ((xmax - xmin) * (ymax - ymin) + (-87.2::DOUBLE + 87.5) * (41.7::DOUBLE - 41.3) - n) AS iou FROM i) SELECT area_id, round(2.0::DOUBLE + CASE WHEN region = 1 THEN 1 ELSE 0 END + CASE WHEN iou > 0 THEN 0.75 ELSE 0 END + iou + CASE WHEN area_id % 2 = 0 THEN 0.2 ELSE 0 END, 9) AS score FROM j"),
    "g09_unit_convert": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round(p_size * 1000.0::DOUBLE / 1609.344::DOUBLE, 9) WHEN 1 THEN round(p_size * 0.3048::DOUBLE / 1609.344::DOUBLE, 9) END AS miles FROM part",
    "g10_agrees_within": "SELECT p_partkey, abs(p_retailprice - round(p_retailprice, -1)) <= 0.004::DOUBLE * greatest(p_retailprice, round(p_retailprice, -1)) AS agrees FROM part",
    "j09_cited_dois": "WITH p AS (SELECT p_partkey, lower('10.1234/P' || p_partkey) AS doi, 'cites https://doi.org/10.1234/P' || (p_partkey * 7) % 2500 || ', and 10.1234/p' || p_partkey || '.' AS body FROM part), c AS (SELECT DISTINCT p_partkey AS element, unnest(list_transform(regexp_extract_all(lower(body), '10\\.[0-9]{4,9}/[^\\s<>]+'), lambda d: regexp_replace(d, '[.,;:)\\]}]+$', ''))) AS doi FROM p) SELECT p.p_partkey AS spec, element, doi, 'high' AS confidence FROM c JOIN p USING (doi) WHERE p.p_partkey <> element",
    "j17_zonal_join": V.sql_with("pixels", "area_boxes", body=", p AS (SELECT *, -88 + (pcol + 0.5::DOUBLE) / 100 AS lon, 41 + (prow + 0.5::DOUBLE) / 100 AS lat FROM pixels) SELECT area_id, count(*) AS cells, round(avg(value), 6) AS mean FROM p JOIN area_boxes a ON p.lon >= a.xmin AND p.lon < a.xmax AND p.lat >= a.ymin AND p.lat < a.ymax GROUP BY 1"),
    "j19_attach_record": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "j23_author_lookup": "SELECT o_orderkey, c_name, round(log10(o_totalprice + 1) * 0.3::DOUBLE, 9) AS score FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(c_name, '007') AND c_custkey % 3 <> 0",
    "j24_lookups": "WITH r AS (SELECT DISTINCT b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = 7 AND b.l_partkey <> 7), x AS (SELECT p_partkey, list_filter([CASE WHEN p_brand = 'Brand#3' THEN 'organization' END, CASE WHEN list_contains(string_split(p_name, ' '), 'small') THEN 'tag' END, CASE WHEN p_type = 'PROMO' THEN 'type' END, CASE WHEN p_partkey IN (FROM r) THEN 'related' END, CASE WHEN p_partkey % 100 < 10 THEN 'collection' END], lambda f: f IS NOT NULL) AS f FROM part) SELECT p_partkey, CASE WHEN list_contains(f, 'tag') THEN 1.5 ELSE 0 END::DOUBLE AS score, array_to_string(f, ',') AS found_by FROM x WHERE len(f) > 0",
    "j29_spec_to_unit": "SELECT s_suppkey, p_partkey, replace(p_name, ' ', '_') AS matched, 'low' AS confidence FROM supplier, part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND replace(p_name, ' ', '_') IN ('small_ring', 'red_widget_(small_ring)', 'lib.module.small_bolt(x)', 'tool_' || s_suppkey)",
    "m03_term_hit": "SELECT p_partkey, regexp_matches(p_name, '(?i)(^|[^\\p{L}\\p{N}])widget(s|es|ing|ed)?($|[^\\p{L}\\p{N}])') AS hit, regexp_matches(p_name, '(?i)(^|[^\\p{L}\\p{N}])wid(s|es|ing|ed)?($|[^\\p{L}\\p{N}])') AS part_hit FROM part",
    "m20_split_name": "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, substr(p_name, length(split_part(p_name, ' ', 1)) + 2) AS last FROM part",
    "r02_weighted_fulltext": _R02,
    "r06_all_arms": f"WITH k AS ({Q.SQL['r01_bm25_search']}), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT item_id, b.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM benchmark JOIN e a ON a.vec_id = item_id JOIN e b ON b.vec_id <> a.vec_id AND b.vec_id IN (SELECT doc_id FROM documents)), v AS (SELECT item_id, vec_id, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, vec_id) <= 10), a AS (SELECT item_id, doc_id, 'keyword' AS arm, rank FROM k UNION ALL SELECT item_id, vec_id, 'semantic', row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, vec_id) FROM v) SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS fused, string_agg(arm, '+' ORDER BY arm) AS arms FROM a GROUP BY 1, 2",
    "s18_record_tables": _S18,
    "t02_by_popularity": "SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY clicks DESC, user_id LIMIT 30",
    "t03_graph_score": "SELECT user_id, round(log10(count(*) FILTER (event_type = 'click') + 1) * 0.3::DOUBLE + count(DISTINCT event_type) * 0.05::DOUBLE, 9) AS score FROM events GROUP BY 1",
    "t04_keyword_graph_rank": "WITH h AS (SELECT p_partkey, contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT + contains(p_name, 'promo')::INT AS a, contains(lower(p_type), 'red')::INT + contains(lower(p_type), 'ring')::INT + contains(lower(p_type), 'promo')::INT AS b FROM part), u AS (SELECT l_partkey AS p_partkey, count(*) AS clicks, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1) SELECT p_partkey, round(a * 2 + b + log10(coalesce(clicks, 0) + 1) * 0.2::DOUBLE + coalesce(degree, 0) * 0.05::DOUBLE, 9) AS score FROM h LEFT JOIN u USING (p_partkey) WHERE a + b > 0",
    "u07_disjoint_runs": "WITH e AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), d AS (SELECT DISTINCT day FROM e), o AS (SELECT DISTINCT a.day FROM e a JOIN e b ON b.day = a.day + 1 AND a.user_id = b.user_id) SELECT d.day, o.day IS NOT NULL AS comparable FROM d JOIN d n ON n.day = d.day + 1 LEFT JOIN o ON o.day = d.day",
    "w07_collapse_shared": "SELECT p_partkey, p_name, p_brand, count(*) OVER (PARTITION BY p_name, p_brand) AS siblings FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) = 1",
    "w08_floor_promote": "WITH e AS (SELECT event_id % 40 AS case_id, event_type, value, event_id, row_number() OVER (PARTITION BY event_id % 40, event_type ORDER BY value DESC, event_id) AS k FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (event_type = 'purchase' AND k <= 4)::INT DESC, value DESC, event_id) AS n FROM e) SELECT case_id, event_id, event_type, value, (row_number() OVER (PARTITION BY case_id ORDER BY value DESC, event_id))::INT AS rank FROM n WHERE n <= 8",
}
