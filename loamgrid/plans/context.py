"""Queries of conversations, citations, links and detected columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import context as C
from loamgrid.operators import tables as T
from loamgrid.operators.pairs import dealt
from loamgrid.plans import retrieval as Q
from loamgrid.plans import views as V
from loamgrid.plans.views import read

BOX = (-87.75, 41.2, -87.25, 41.8)


def r07(spark, d):
    return C.select_relevant_context(read(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn", "text")


def m06(spark, d):
    """Each part's name as an earlier question, and a follow-up with or without a pronoun."""
    p = read(spark, d, "part")
    earlier = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Show me the "), "p_name"), F.concat(F.lit("What about "), "p_brand")))
    followup = F.when(F.col("p_partkey") % 2 == 0, F.lit("where is it sold")).otherwise("  cheapest in stock ")
    return p.select("p_partkey", C.rewrite_with_context(earlier, followup).alias("query"))


def m10(spark, d):
    """Links to elements in made-up sentences about parts: two hosts, one element named twice."""
    h = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.concat(F.lit("see https://portal.example.org/Notebooks/"), F.upper(uuid), F.lit(") and https://store.example.org/files/x/"), uuid, F.lit("/a.zip</td, again http://portal.example.org/maps/"), uuid, F.lit(". Not https://other.example.org/maps/"), uuid)
    cited = C.platform_citations(text, {"portal.example.org": "CITES", "store.example.org": "USES"})
    return dealt(read(spark, d, "part").select("p_partkey")).select("p_partkey", F.posexplode(cited).alias("k", "c")).select("p_partkey", "k", "c.element_id", "c.rel", "c.hint")


def m17(spark, d):
    text = F.concat(F.lit("The size is "), F.col("p_size"), F.lit(" m. It would be "), F.col("p_partkey"), F.lit(" ft, but the form gives "), F.col("p_size"), F.lit(".\nFor reference "), F.col("p_brand"), F.lit("!\nDone"))
    return read(spark, d, "part").select("p_partkey", C.strip_asides(text).alias("text"))


def m21(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 6
    query = (
        F.when(k == 0, F.concat(F.lit("publications by John "), F.initcap(F.element_at(F.split("p_name", " "), 1)))).when(k == 1, F.concat(F.lit("maps within the "), F.col("p_name"), F.lit(" collection")))
        .when(k == 2, F.concat(F.lit("things similar to "), F.col("p_name"))).when(k == 3, F.concat(F.lit("items tagged with "), F.col("p_name"))).when(k == 4, F.lit("please list all datasets")).otherwise("what is climate change")
    )
    found = C.detect_lookup(query)
    return p.select("p_partkey", found["name"].alias("name"), found["value"].alias("value"))


def w14(spark, d):
    """Supplier and part by all their lines: returned lines are strong evidence, accepted ones medium."""
    rank = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    links = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", rank.alias("confidence"), "l_orderkey", "l_linenumber")
    return C.best_of_pair(links, "l_suppkey", "l_partkey", "confidence", ["l_orderkey", "l_linenumber"])


def u06(spark, d):
    """Two runs' lineage, with orders of either and of both, merged twice."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") % 3).alias("run"))  # noqa: E741
    one, two = l.where("run <> 0").drop("run"), l.where("run <> 1").drop("run")
    merged = C.merge_lineage(C.merge_lineage(one, two), two)
    return merged.groupBy("src").agg(F.count("*").alias("edges"), F.min("dst").alias("least"))


def t06(spark, d):
    """All matches of a search, without a limit."""
    return C.spatial_search(V.event_points(spark, d), BOX, {"event_type": 3.0, "props": 2.0}).select("event_id", "event_type")


def f12(spark, d):
    """Points of some kinds in a box, scored by the best field that holds the keyword."""
    p = V.event_points(spark, d).withColumn("words", F.regexp_replace("props", "[^0-9]+", " "))
    out = C.spatial_search(p, BOX, {"event_type": 3.0, "words": 2.0}, "7", ("event_type", ["error", "click"]))
    return out.select("event_id", "score")


def d02(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.date_format("o_orderdate", "MM/dd/yyyy").alias("shipped_date"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("half"), F.lpad(F.col("o_custkey").cast("string"), 4, "0").alias("beat"), F.year("o_orderdate").alias("order_year"))
    return T.time_columns(o).select("column", "rows", "parsed_rows", F.round("parse_rate", 6).alias("parse_rate"), "name_suggests_time", "rank")


QUERIES = {
    "d02_time_columns": d02, "f12_spatial_search": f12, "m06_rewrite_with_context": m06, "m10_platform_citations": m10, "m17_strip_asides": m17, "m21_detect_lookup": m21, "r07_relevant_context": r07, "t06_scan_all": t06,
    "u06_merge_lineage": u06, "w14_best_of_pair": w14,
}

_IN_BOX = "lon BETWEEN -87.75 AND -87.25 AND lat BETWEEN 41.2 AND 41.8"

SQL = {
    "d02_time_columns": "WITH n AS (SELECT least(count(*), 4000) AS n FROM orders) SELECT c AS \"column\", n AS rows, n AS parsed_rows, 1.0::DOUBLE AS parse_rate, hint AS name_suggests_time, k::INT AS rank FROM n, (VALUES ('o_orderdate', true, 1), ('shipped_date', true, 2), ('order_year', true, 3)) t(c, hint, k)",
    "f12_spatial_search": V.sql_with("event_points", body=f", s AS (SELECT event_id, CASE WHEN regexp_matches(props, '(^|[^0-9])7($|[^0-9])') THEN 2.0::DOUBLE ELSE 0 END AS score FROM event_points WHERE {_IN_BOX} AND event_type IN ('error', 'click')) SELECT * FROM s WHERE score > 0"),
    "m06_rewrite_with_context": "WITH q AS (SELECT p_partkey, 'me ' || p_name || ' ; ' || replace(lower(p_brand), '#', ' ') AS focus FROM part), r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'where is it sold' ELSE 'cheapest in stock' END WHEN p_partkey % 2 = 0 THEN 'where is ' || focus || ' sold' ELSE focus || ' cheapest in stock' END AS query FROM q) SELECT p_partkey, array_to_string(string_split(query, ' ')[1:12], ' ') AS query FROM r",
    "m10_platform_citations": "WITH h AS (SELECT p_partkey, md5(p_partkey::VARCHAR) AS h FROM part), u AS (SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS element_id FROM h) SELECT p_partkey, k, element_id, rel, hint FROM u, (VALUES (0, 'CITES', 'notebooks'), (1, 'USES', 'files')) t(k, rel, hint)",
    "m17_strip_asides": r"""WITH t AS (SELECT p_partkey, 'The size is ' || p_size || ' m. It would be ' || p_partkey || ' ft, but the form gives ' || p_size || '.' || chr(10) || 'For reference ' || p_brand || '!' || chr(10) || 'Done' AS t FROM part),
c AS (SELECT p_partkey, string_split(regexp_replace(regexp_replace(t, '[.!?]\s|\n', '\0' || chr(1), 'g'), '(?i)[,;:–—]?\s*\b(but|however|whereas)\b', chr(1) || '\0', 'g'), chr(1)) AS c FROM t)
SELECT p_partkey, array_to_string(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '(?i)\b(would|could|might|for reference)\b') THEN regexp_replace(x, '\S', ' ', 'g') ELSE x END), '') AS text FROM c""",
    "m21_detect_lookup": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'by_author' WHEN 1 THEN 'in_collection' WHEN 2 THEN 'related_to' WHEN 3 THEN 'by_tag' WHEN 4 THEN 'by_resource_type' END AS name, CASE p_partkey % 6 WHEN 0 THEN 'John ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] WHEN 4 THEN 'datasets' WHEN 5 THEN NULL ELSE p_name END AS value FROM part",
    "r07_relevant_context": f"""WITH u AS (SELECT conv_id, turn, {Q._WORDS.format(c='text')} AS ws FROM conversations WHERE role = 'user'), x AS (SELECT conv_id, turn, unnest(ws) AS term FROM u), f AS (SELECT conv_id, turn, term, count(*) AS tf FROM x GROUP BY ALL),
g AS (SELECT term, ln(((SELECT count(*) FROM u) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM f GROUP BY 1), w AS (SELECT conv_id, turn, term, tf * idf AS w FROM f JOIN g USING (term)), s AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS size FROM w GROUP BY 1, 2), l AS (SELECT conv_id, max(turn) AS asked FROM u GROUP BY 1),
d AS (SELECT o.conv_id, l.asked, o.turn AS pos, sum(o.w * n.w) AS dot FROM w o JOIN l ON l.conv_id = o.conv_id AND o.turn < l.asked JOIN w n ON n.conv_id = o.conv_id AND n.turn = l.asked AND n.term = o.term GROUP BY ALL),
c AS (SELECT d.conv_id, asked, pos, round(dot / (a.size * b.size), 6) AS cosine FROM d JOIN s a ON a.conv_id = d.conv_id AND a.turn = pos JOIN s b ON b.conv_id = d.conv_id AND b.turn = asked)
SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY cosine DESC, pos))::INT AS rank FROM c WHERE cosine >= 0.35 QUALIFY rank <= 3""",
    "t06_scan_all": V.sql_with("event_points", body=f" SELECT event_id, event_type FROM event_points WHERE {_IN_BOX}"),
    "u06_merge_lineage": "SELECT l_orderkey AS src, count(DISTINCT l_partkey) AS edges, min(l_partkey) AS least FROM lineitem GROUP BY 1",
    "w14_best_of_pair": "WITH l AS (SELECT l_suppkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence, l_orderkey, l_linenumber FROM lineitem) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, l_orderkey, l_linenumber) = 1",
}
