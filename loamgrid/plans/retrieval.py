"""Queries of text functions, search, fusion and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import lookups as U
from loamgrid.operators import retrieval as R
from loamgrid.operators import tables as T
from loamgrid.operators.fingerprints import corpus_fingerprint
from loamgrid.plans.views import read


def _bench(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))


def r01(spark, d):
    scored = R.bm25(read(spark, d, "documents"), _bench(spark, d), "doc_id", "text", "item_id", "query").withColumn("score", F.round("score", 6))
    return R.top_per(scored, "item_id", 10, [F.desc("score"), "doc_id"])


def r03(spark, d):
    pages = read(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), F.col("url"))
    out = R.idf_field_search(pages, _bench(spark, d), "page_id", {"title": 4.0, "url": 1.0}, "item_id", "query")
    return out.withColumn("score", F.round("score", 6))


def r04(spark, d):
    """How many of the query's words each part name holds."""
    q = X.words(F.lit("small red widget ring bolts"))
    return read(spark, d, "part").select("p_partkey", F.size(F.filter(q, lambda w: F.contains(F.col("p_name"), w))).alias("overlap")).where("overlap > 0")


def r05(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.knn(q, v, "query_id", "q", "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


def r08(spark, d):
    """One minus the cosine of each vector to the first of its label."""
    v = read(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return v.join(first, "label").select("vec_id", "label", (F.round(1 - R.cosine(F.col("embedding"), F.col("base")), 6) + 0.0).alias("change"))


def r08_pairs(spark, d):
    """How alike the pooled vectors of each two labels are: cosine and distance."""
    pooled = R.pooled(read(spark, d, "embeddings"), "label", "embedding")
    a, b = pooled.select(F.col("label").alias("label_a"), F.col("pooled").alias("a")), pooled.select(F.col("label").alias("label_b"), F.col("pooled").alias("b"))
    return R.pair_similarity(a.join(b, F.col("label_a") < F.col("label_b")), "a", "b").select("label_a", "label_b", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance"))


def f25(spark, d):
    v = read(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 13 != 0, F.col("embedding")))
    return v.select("vec_id", R.vector_refusal(F.col("v"), 64).alias("refusal"))


def _lists(spark, d):
    e = read(spark, d, "events")
    return e.select((F.col("event_id") % 50).alias("case_id"), F.col("event_type").alias("arm"), F.col("user_id").alias("item"), F.col("value").alias("score"), F.col("event_id").alias("pos"))


def w01(spark, d):
    return R.rrf(_lists(spark, d), "case_id", "arm", "item", "score", "pos").withColumn("fused", F.round("fused", 9))


def w02(spark, d):
    return T.keep_first(_lists(spark, d), ["case_id", "item"], ["pos"]).select("case_id", "item", "pos", "arm")


def w03(spark, d):
    linkable = (F.col("arm") == "click").cast("int")
    return T.keep_first(_lists(spark, d), ["case_id", "item"], [linkable.desc(), "pos"]).select("case_id", "item", "pos", "arm")


def w04(spark, d):
    """Keyword hits first, then semantic ones; both: marked so."""
    rows = _lists(spark, d)
    rank = lambda arm: R.top_per(T.keep_first(rows.where(F.col("arm") == arm), ["case_id", "item"], ["pos"]), "case_id", 20, [F.desc("score"), "pos"]).select("case_id", "item", F.col("rank").alias(arm))
    both = rank("click").join(rank("view"), ["case_id", "item"], "full_outer")
    source = F.when(F.col("click").isNotNull() & F.col("view").isNotNull(), "keyword+semantic").when(F.col("click").isNotNull(), "keyword").otherwise("semantic")
    return R.top_per(both.withColumn("source", source), "case_id", 10, [F.col("click").asc_nulls_last(), F.col("view").asc_nulls_last(), "item"]).select("case_id", "item", "source", "rank")


def w10(spark, d):
    c = read(spark, d, "conversations").withColumn("size", F.length("text"))
    return R.cumulative_budget(c, "conv_id", ["turn"], "size", 1500, 10).select("conv_id", "turn", "upto")


def w13(spark, d):
    """A user's leading type, dropped where the runner-up is over 0.8 of it."""
    counted = read(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("arm")).agg(F.round(F.sum("value"), 6).alias("total"))
    w = Window.partitionBy("case_id").orderBy(F.desc("total"), "arm")
    led = counted.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("total").over(w)).where("n = 1")
    return led.where(F.coalesce(F.col("second") <= F.col("total") * 0.8, F.lit(True))).select("case_id", "arm", "total")


def a26(spark, d):
    hits = r01(spark, d)
    expected = R.holders(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    out = R.retrieval_scores(hits, expected, "item_id", "doc_id", 10)
    return out.select("item_id", "found", "expected", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


def a27(spark, d):
    s = a26(spark, d)
    return s.agg(F.count("*").alias("cases"), F.count_if(F.col("reciprocal_rank") == 1).alias("r1"), F.count_if(F.col("reciprocal_rank") >= 0.333).alias("r3"), F.count_if(F.col("reciprocal_rank") > 0).alias("r10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def a30(spark, d):
    return _lists(spark, d).groupBy("case_id", "arm").agg(F.count("*").alias("n"), F.max("score").alias("top"))


def a31(spark, d):
    """Share of documents of a source whose first 600 characters hold a frequent word."""
    return U.term_coverage(read(spark, d, "documents"), "source", "text", ["ning", "ción"])


def a32(spark, d):
    return corpus_fingerprint(read(spark, d, "documents"), "doc_id", ["text", "lang", "source"])


def f14(spark, d):
    """One term: title or text; several: a hit in the title, or two different ones."""
    p = read(spark, d, "part")
    terms = ["red", "ring", "small"]
    in_name = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: X.term_hit(t, F.col("p_name"))))
    in_type = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: X.term_hit(t, F.col("p_type"))))
    return p.where((in_type >= 1) | (in_name >= 2)).select("p_partkey", "p_name")


def f15(spark, d):
    """Hits with evidence; a query that has none keeps all its hits."""
    rows = _lists(spark, d).withColumn("evidence", (F.col("score") > 90).cast("int"))
    any_hit = F.max("evidence").over(Window.partitionBy("case_id", "arm"))
    return rows.withColumn("any", any_hit).where("any = 0 or evidence = 1").select("case_id", "arm", "pos")


def f16(spark, d):
    """Vocabulary score; short texts are let in."""
    score = U.vocabulary_score(F.col("text"), ["ningthe", "ciónque"], ["tion", "ment", "heit"], ["$$$", "!!"])
    return read(spark, d, "documents").select("doc_id", score.alias("score"), ((score >= 3) | (F.length("text") < 120)).alias("admitted"))


def f21(spark, d):
    """What is served in place of a document: four in seven texts are short ones with such a phrase, one a long one that only holds it."""
    k = F.col("doc_id") % 7
    said = F.when(k == 0, "Please CONFIRM you are a human").when(k == 1, "Subscribe to view this").when(k == 2, "404 Not Found").when(k == 3, "We use cookies").when(k == 4, F.concat(F.repeat(F.lit("word "), F.lit(900)), F.lit("we use cookies")))
    text = F.when(k <= 3, F.concat(said, F.lit(" "), F.substring("text", 1, 500))).when(k == 4, said).otherwise(F.col("text"))
    return read(spark, d, "documents").groupBy(U.page_kind(text, U.SERVED_INSTEAD).alias("kind")).agg(F.count("*").alias("n"))


def f22(spark, d):
    """Outcomes of reading documents, by reasons that their ids stand for, and how many characters each outcome has."""
    reasons = ["", "looks like a paywall or login page", "file is EMPTY (0 bytes)", "pdf has no text layer", "is a zip archive", "could not parse: bad xref", "content is HTML although named .pdf"]
    reason = F.element_at(F.array(*map(F.lit, reasons)), (F.col("doc_id") % 7 + 1).cast("int"))
    chars = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.length(F.coalesce("text", F.lit(""))))
    return read(spark, d, "documents").groupBy(U.reach_bucket(reason, chars).alias("bucket")).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))


def f23(spark, d):
    c = read(spark, d, "conversations").where("role = 'user'")
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("And what about that: "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.regexp_like(text, F.lit(X.FOLLOW_UPS)).alias("needs_context"))


def f27(spark, d):
    kind = U.link_kind(F.col("url"), {"portal": ["example.com"], "opaque": ["example.net"], "deposit": ["example.org"]})
    return read(spark, d, "pages").select("page_id", kind.alias("kind"))


def m01(spark, d):
    text = F.concat(F.lit("get"), F.initcap("p_name"), F.lit("_"), F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.identifier_tokens(text)), " ").alias("tokens"))


def m02(spark, d):
    w = F.element_at(F.split("p_name", " "), -1)
    words = [F.concat(w, F.lit(s)) for s in ("", "s", "es", "ing", "ies")]
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array(*[X.stem_plural(x) for x in words]), ",").alias("plural"), F.array_join(F.array(*[X.stem_crude(x) for x in words]), ",").alias("crude"), F.array_join(F.array(*[X.stem_long(x) for x in words]), ",").alias("long"))


def m05(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(X.meaningful_terms(F.col("text")), 1, 6), " ").alias("keywords"))


def m07(spark, d):
    return read(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


def m08(spark, d):
    url = F.concat(F.lit("https://github.com/o"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/r/blob/main/").when(F.col("p_partkey") % 3 == 1, "/r/tree/main/").otherwise("/r/raw/main/"), F.replace("p_name", F.lit(" "), F.lit("/")))
    return read(spark, d, "part").select("p_partkey", X.blob_to_raw(url).alias("raw"))


def m09(spark, d):
    text = F.concat(F.lit("See https://doi.org/10.1234/AB."), F.col("p_partkey"), F.lit(") and doi:10.5555/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(", twice 10.5555/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("."))
    return read(spark, d, "part").select("p_partkey", F.array_join(X.dois(text), " ").alias("dois"))


def m11(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, " and ").when(F.col("p_partkey") % 4 == 1, "& ").when(F.col("p_partkey") % 4 == 2, "AND  ").otherwise("Andy "), F.lit("Dr. "), F.initcap("p_name"), F.lit(", J.-P. (éd.)"))
    error = F.concat(F.lit("io."), F.replace(F.initcap("p_type"), F.lit(" "), F.lit("")), F.lit("Error: x"))
    tag = F.concat(name, F.lit("/ü"), F.repeat("p_brand", 20))
    return read(spark, d, "part").select("p_partkey", X.author_key(name).alias("author"), X.slug(F.concat_ws(" -- ", "p_brand", "p_name")).alias("slug"), X.error_class(error).alias("error"), X.sanitize_tag(tag).alias("tag"))


def m13(spark, d):
    text = X.html_to_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), F.contains(text, F.lit("<")).alias("angle"))


def m14(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return R.select_passages(docs, "doc_id", "text", F.lit("license"), 2000).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


def m15(spark, d):
    chunks = X.paragraph_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1500)
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "t")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("t")).alias("longest"), F.sum(F.length("t")).alias("chars"))


def m16(spark, d):
    text = F.concat(F.lit("about "), F.col("p_size"), F.lit(" km and price "), F.col("p_retailprice"), F.lit(" or 1,5"), F.col("p_size") % 10, F.lit("0 m"))
    return read(spark, d, "part").select("p_partkey", F.posexplode(X.numbers_in(text)).alias("k", "n")).select("p_partkey", "k", "n.value", "n.unit", "n.before")


QUERIES = {
    "r01_bm25_search": r01, "r03_method_search": r03, "r04_overlap_search": r04, "r05_knn_search": r05, "r08_change_curve": r08, "r08_pair_similarity": r08_pairs, "f25_vector_refusal": f25, "w01_rrf_fuse": w01, "w02_dedupe_keep_first": w02, "w03_dedupe_prefer_linkable": w03,
    "w04_hybrid_merge": w04, "w10_cumulative_budget": w10, "w13_runner_up_margin": w13, "a26_retrieval_eval": a26, "a27_recall_mrr": a27, "a30_evidence_summary": a30, "a31_term_coverage": a31, "a32_corpus_fingerprint": a32,
    "f14_relevance_gate": f14, "f15_hit_filter": f15, "f16_domain_relevance": f16, "f21_classify_document": f21, "f22_reach_bucket": f22, "f23_needs_context": f23, "f27_link_kind": f27, "m01_tokens": m01, "m02_stems": m02, "m05_keyword_summary": m05,
    "m07_canonical_url": m07, "m08_blob_to_raw": m08, "m09_dois": m09, "m11_keys": m11, "m13_html_to_text": m13, "m14_select_passages": m14, "m15_paragraph_chunks": m15, "m16_extract_numbers": m16,
}

_WORDS = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_BENCH = "q AS (SELECT item_id, text AS query FROM benchmark)"
_BM25 = f"""WITH {_BENCH}, t AS (SELECT DISTINCT item_id, unnest({_WORDS.format(c='query')}) AS term FROM q),
w AS (SELECT doc_id, {_WORDS.format(c='text')} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
x AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM t) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
b AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM f JOIN g USING (term) JOIN t USING (term), s GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM b), hits AS (SELECT * FROM r WHERE rank <= 10)"""
_EVAL = _BM25 + """, e AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, count(*) AS found, min(rank) AS first FROM hits JOIN e USING (item_id, doc_id) GROUP BY 1),
ev AS (SELECT e.item_id, coalesce(any_value(h.found), 0) AS found, count(*) AS expected, round(coalesce(any_value(h.found), 0) / count(*), 6) AS recall, round(coalesce(any_value(h.found), 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1 / any_value(h.first), 0), 6) AS reciprocal_rank FROM e LEFT JOIN h USING (item_id) GROUP BY 1)"""
_LISTS = "l AS (SELECT event_id % 50 AS case_id, event_type AS arm, user_id AS item, value AS score, event_id AS pos FROM events)"
_PLURAL = "CASE WHEN regexp_matches({w}, 'ies$') AND length({w}) > 4 THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') AND length({w}) > 4 THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, '[^s]s$') AND length({w}) > 3 THEN regexp_replace({w}, 's$', '') ELSE {w} END"
_CRUDE = "CASE WHEN regexp_matches({w}, 'ing$') AND length({w}) >= 7 THEN regexp_replace({w}, 'ing$', '') WHEN regexp_matches({w}, 'ies$') AND length({w}) >= 6 THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, 'es$') AND length({w}) >= 6 THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, 's$') AND length({w}) >= 5 THEN regexp_replace({w}, 's$', '') ELSE {w} END"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TRACK = ", ".join(f"'{w}'" for w in X.TRACKING)


_CUT = "CASE " + " ".join(f"WHEN ends_with({{w}}, '{e}') AND length({{w}}) >= {len(e) + 3} THEN left({{w}}, length({{w}}) - {len(e)})" for e in X.LONG_ENDINGS) + " ELSE {w} END"
_LONG = f"list_transform([{_CUT}], lambda c: CASE WHEN length(c) > 3 AND substr(c, -1, 1) = substr(c, -2, 1) AND NOT contains('aeiou', substr(c, -1, 1)) THEN left(c, length(c) - 1) ELSE c END)[1]"
_M11_NAME = "CASE p_partkey % 4 WHEN 0 THEN ' and ' WHEN 1 THEN '& ' WHEN 2 THEN 'AND  ' ELSE 'Andy ' END || 'Dr. ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ', J.-P. (éd.)'"


def _endings(rule: str) -> str:
    return "concat_ws(',', " + ", ".join(rule.format(w=f"(w || '{s}')") for s in ("", "s", "es", "ing", "ies")) + ")"


def _sum_hits(*words: str) -> str:
    return " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words)


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"

_A32 = "WITH r AS (SELECT doc_id, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, chr(26)), coalesce(lang, chr(26)), coalesce(source, chr(26)))) AS h, substr(sha256(doc_id::VARCHAR), 1, 4) AS node FROM documents), n4 AS (SELECT node, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h FROM r GROUP BY 1)"
_A32 += "".join(f", n{k} AS (SELECT substr(node, 1, {k}) AS up, sha256(string_agg(node || ':' || h, ',' ORDER BY node)) AS h FROM (SELECT {'node' if k == 3 else 'up AS node'}, h FROM n{k + 1}) GROUP BY 1)" for k in (3, 2, 1, 0))
_A32 += " SELECT (SELECT count(*) FROM documents) AS n, h AS digest FROM n0"

def _text_of_page(html: str) -> str:
    """What a page shows, step by step as expressions that stand inside one another."""
    t = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    inner = [f"nullif(regexp_extract({t}, '(?is)<{tag}\\b[^>]*>(.*)</{tag}\\s*>', 1), '')" for tag in ("main", "article")]
    t = f"coalesce({', '.join(inner)}, {t})"
    for tag in ("script", "style", "noscript", "svg", "nav", "header", "footer", "form", "head"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|main|blockquote|pre)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, sign in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {sign})"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim({t}, ' ' || chr(10))"


_M13 = f"WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_text_of_page('html')} AS t FROM pages) SELECT page_id, title, md5(t) AS text_md5, contains(t, '<') AS angle FROM t"
_M15 = r"""WITH c AS (SELECT doc_id, list_reduce(list_transform(list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p) <> ''), lambda p: [p]),
lambda a, p: CASE WHEN length(a[-1]) + 2 + length(p[1]) <= 1500 THEN list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || p[1]]) ELSE list_concat(a, p) END) AS cs FROM documents
WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p) <> '')) > 0),
u AS (SELECT doc_id, unnest(cs) AS t FROM c) SELECT doc_id, count(*) AS chunks, max(length(t)) AS longest, sum(length(t))::BIGINT AS chars FROM u GROUP BY 1"""

SQL = {
    "m13_html_to_text": _M13,
    "m15_paragraph_chunks": _M15,
    "r01_bm25_search": _BM25 + " SELECT * FROM hits",
    "a26_retrieval_eval": _EVAL + " SELECT * FROM ev",
    "a27_recall_mrr": _EVAL + " SELECT count(*) AS cases, count(*) FILTER (reciprocal_rank = 1) AS r1, count(*) FILTER (reciprocal_rank >= 0.333) AS r3, count(*) FILTER (reciprocal_rank > 0) AS r10, round(avg(reciprocal_rank), 6) AS mrr FROM ev",
    "r03_method_search": f"""WITH {_BENCH}, p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, url FROM pages),
u AS (SELECT page_id, unnest({_WORDS.format(c='title')}) AS w, 4.0::DOUBLE AS weight FROM p UNION ALL SELECT page_id, unnest({_WORDS.format(c='url')}), 1.0 FROM p), v AS (SELECT DISTINCT page_id, {_PLURAL.format(w='w')} AS term, weight FROM u),
t0 AS (SELECT item_id, unnest({_WORDS.format(c='query')}) AS w FROM q), t AS (SELECT DISTINCT item_id, {_PLURAL.format(w='w')} AS term FROM t0),
h AS (SELECT page_id, term, sum(weight) AS weight FROM v WHERE term IN (SELECT term FROM t) GROUP BY 1, 2), g AS (SELECT term, ln(((SELECT count(*) FROM pages) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM h GROUP BY 1)
SELECT item_id, page_id, round(sum(weight * idf), 6) AS score FROM h JOIN g USING (term) JOIN t USING (term) GROUP BY 1, 2""",
    "r04_overlap_search": "WITH o AS (SELECT p_partkey, contains(p_name, 'small')::INT + contains(p_name, 'red')::INT + contains(p_name, 'widget')::INT + contains(p_name, 'ring')::INT + contains(p_name, 'bolts')::INT AS overlap FROM part) SELECT * FROM o WHERE overlap > 0",
    "r05_knn_search": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a='q.e', b='v.e')}, 9) AS c FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM p) SELECT query_id, vec_id, round(c, 6) AS cosine FROM r WHERE k <= 10",
    "r08_pair_similarity": f"WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS v FROM x GROUP BY 1, 2), p AS (SELECT label, list(v ORDER BY k) AS e FROM m GROUP BY 1) SELECT a.label AS label_a, b.label AS label_b, round({_COS.format(a='a.e', b='b.e')}, 6) AS cosine, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM p a JOIN p b ON a.label < b.label",
    "r08_change_curve": f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, first_value(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, label, round(1 - {_COS.format(a='e', b='b')}, 6) + 0 AS change FROM v",
    "f25_vector_refusal": "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:10] WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: x * 0) WHEN vec_id % 13 <> 0 THEN embedding END AS v FROM embeddings) SELECT vec_id, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> 64 THEN 'width' WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'all zero' END AS refusal FROM v",
    "w01_rrf_fuse": f"WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, arm ORDER BY score DESC, pos) AS r FROM l) SELECT case_id, item, round(sum(1 / (60 + r)), 9) AS fused FROM r GROUP BY 1, 2",
    "w02_dedupe_keep_first": f"WITH {_LISTS} SELECT case_id, item, pos, arm FROM l QUALIFY row_number() OVER (PARTITION BY case_id, item ORDER BY pos) = 1",
    "w03_dedupe_prefer_linkable": f"WITH {_LISTS} SELECT case_id, item, pos, arm FROM l QUALIFY row_number() OVER (PARTITION BY case_id, item ORDER BY (arm = 'click')::INT DESC, pos) = 1",
    "w04_hybrid_merge": f"""WITH {_LISTS}, u AS (SELECT * FROM l WHERE arm IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY case_id, arm, item ORDER BY pos) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, arm ORDER BY score DESC, pos) AS r FROM u QUALIFY r <= 20),
b AS (SELECT case_id, item, min(r) FILTER (arm = 'click') AS c, min(r) FILTER (arm = 'view') AS v FROM r GROUP BY 1, 2), o AS (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY c NULLS LAST, v NULLS LAST, item))::INT AS rank FROM b)
SELECT case_id, item, CASE WHEN c IS NOT NULL AND v IS NOT NULL THEN 'keyword+semantic' WHEN c IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source, rank FROM o WHERE rank <= 10""",
    "w10_cumulative_budget": "WITH r AS (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, upto FROM r WHERE (upto <= 1500 OR n = 1) AND n <= 10",
    "w13_runner_up_margin": "WITH c AS (SELECT user_id AS case_id, event_type AS arm, round(sum(value), 6) AS total FROM events GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total DESC, arm) AS n, lead(total) OVER (PARTITION BY case_id ORDER BY total DESC, arm) AS second FROM c) SELECT case_id, arm, total FROM w WHERE n = 1 AND coalesce(second <= total * 0.8::DOUBLE, true)",
    "a30_evidence_summary": f"WITH {_LISTS} SELECT case_id, arm, count(*) AS n, max(score) AS top FROM l GROUP BY 1, 2",
    "a31_term_coverage": "SELECT source, round(avg((contains(lower(substr(coalesce(text, ''), 1, 600)), 'ning') OR contains(lower(substr(coalesce(text, ''), 1, 600)), 'ción'))::INT), 2) AS coverage, count(*) AS n FROM documents GROUP BY 1",
    "a32_corpus_fingerprint": _A32,
    "f14_relevance_gate": "SELECT p_partkey, p_name FROM part WHERE (SELECT count(*) FROM (VALUES ('red'), ('ring'), ('small')) t(t) WHERE regexp_matches(p_type, '(?i)(^|[^\\p{L}\\p{N}])' || t || '(s|es|ing|ed)?($|[^\\p{L}\\p{N}])')) >= 1 OR (SELECT count(*) FROM (VALUES ('red'), ('ring'), ('small')) t(t) WHERE regexp_matches(p_name, '(?i)(^|[^\\p{L}\\p{N}])' || t || '(s|es|ing|ed)?($|[^\\p{L}\\p{N}])')) >= 2",
    "f15_hit_filter": f"WITH {_LISTS}, e AS (SELECT *, max((score > 90)::INT) OVER (PARTITION BY case_id, arm) AS hit FROM l) SELECT case_id, arm, pos FROM e WHERE hit = 0 OR score > 90",
    "f16_domain_relevance": f"WITH s AS (SELECT doc_id, length(text) AS n, ({_sum_hits('ningthe', 'ciónque')}) * 3 + {_sum_hits('tion', 'ment', 'heit')} - ({_sum_hits('$$$', '!!')}) * 2 AS score FROM documents) SELECT doc_id, score, score >= 3 OR n < 120 AS admitted FROM s",
    "f21_classify_document": "WITH t AS (SELECT doc_id % 7 AS k, text FROM documents), p AS (SELECT k, CASE k WHEN 0 THEN 'Please CONFIRM you are a human ' || substr(text, 1, 500) WHEN 1 THEN 'Subscribe to view this ' || substr(text, 1, 500) WHEN 2 THEN '404 Not Found ' || substr(text, 1, 500) WHEN 3 THEN 'We use cookies ' || substr(text, 1, 500) WHEN 4 THEN repeat('word ', 900) || 'we use cookies' ELSE text END AS t FROM t) SELECT CASE WHEN length(t) > 4000 OR t IS NULL THEN 'document' WHEN contains(lower(t), 'confirm you are a human') THEN 'a bot-check page' WHEN contains(lower(t), 'subscribe to view') THEN 'a paywall or login page' WHEN contains(lower(t), '404 not found') THEN 'an error page' WHEN contains(lower(t), 'we use cookies') THEN 'a cookie consent page' ELSE 'document' END AS kind, count(*) AS n FROM p GROUP BY 1",
    "f22_reach_bucket": "WITH r AS (SELECT ['', 'looks like a paywall or login page', 'file is empty (0 bytes)', 'pdf has no text layer', 'is a zip archive', 'could not parse: bad xref', 'content is html although named .pdf'][doc_id % 7 + 1] AS reason, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(coalesce(text, '')) END AS chars FROM documents) SELECT CASE WHEN reason = '' AND chars > 0 THEN 'readable' WHEN contains(reason, 'paywall') THEN 'wall' WHEN contains(reason, 'empty (0 bytes)') THEN 'empty' WHEN contains(reason, 'no text layer') THEN 'no text' WHEN contains(reason, 'zip archive') THEN 'wrong type' WHEN contains(reason, 'could not parse') THEN 'broken' WHEN chars > 0 THEN 'readable' ELSE 'wrong type' END AS bucket, count(*) AS n, sum(chars)::BIGINT AS chars FROM r GROUP BY 1",
    "f23_needs_context": f"SELECT conv_id, turn, conv_id % 3 = 0 OR regexp_matches(text, '{X.FOLLOW_UPS}') AS needs_context FROM conversations WHERE role = 'user'",
    "f27_link_kind": "WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?]+)', 1) AS h FROM pages) SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'portal' WHEN regexp_matches(h, '(^|\\.)example\\.net$') THEN 'opaque' WHEN regexp_matches(h, '(^|\\.)example\\.org$') THEN 'deposit' ELSE 'direct' END AS kind FROM h",
    "m02_stems": f"WITH p AS (SELECT p_partkey, split_part(p_name, ' ', -1) AS w FROM part) SELECT p_partkey, {_endings(_PLURAL)} AS plural, {_endings(_CRUDE)} AS crude, {_endings(_LONG)} AS long FROM p",
    "m07_canonical_url": f"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), c AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK}) AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^({'|'.join(X.TRACKING_BEGINNINGS)})')) AS kept FROM b)
SELECT page_id, regexp_replace(regexp_replace(head, '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM c""",
    "m08_blob_to_raw": "WITH u AS (SELECT p_partkey, 'https://github.com/o' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/r/blob/main/' WHEN 1 THEN '/r/tree/main/' ELSE '/r/raw/main/' END || replace(p_name, ' ', '/') AS u FROM part) SELECT p_partkey, regexp_replace(u, '^https?://github\\.com/([^/]+)/([^/]+)/blob/(.+)$', 'https://raw.githubusercontent.com/\\1/\\2/\\3') AS raw FROM u",
    "m09_dois": "WITH t AS (SELECT p_partkey, 'See https://doi.org/10.1234/AB.' || p_partkey || ') and doi:10.5555/' || replace(p_brand, '#', '-') || ', twice 10.5555/' || replace(p_brand, '#', '-') || '.' AS t FROM part), f AS (SELECT p_partkey, list_transform(regexp_extract_all(lower(t), '10\\.[0-9]{4,9}/[^\\s<>]+'), lambda d: regexp_replace(d, '[.,;:)\\]}]+$', '')) AS ds FROM t) SELECT p_partkey, array_to_string(list_filter(ds, lambda d, i: list_position(ds, d) = i), ' ') AS dois FROM f",
    "m11_keys": f"WITH n AS (SELECT *, {_M11_NAME} AS name FROM part) SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(regexp_replace(trim(name), '^(and|&)\\s+', '', 'i'), '[^\\p{{L}}\\p{{N}}_\\s.-]', '', 'g'))), '\\s+', ' ', 'g') AS author, rtrim(substr(trim(regexp_replace(lower(p_brand || ' -- ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-') AS slug, split_part(regexp_extract('io.' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Error: x', '^\\s*([A-Za-z_.]*(?:Error|Exception))\\b', 1), '.', -1) AS error, substr(regexp_replace(name || '/ü' || repeat(p_brand, 20), '[^A-Za-z0-9+=._:/ -]', '_', 'g'), 1, 128) AS tag FROM n",
    "m01_tokens": "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, split_part(p_brand, '#', 2) AS n FROM part), t AS (SELECT p_partkey, unnest(list_distinct(list_concat(['get', 'get' || w[1], 'brand', n], w))) AS t FROM p) SELECT p_partkey, string_agg(t, ' ' ORDER BY t) AS tokens FROM t GROUP BY 1",
    "m05_keyword_summary": f"""WITH w AS (SELECT conv_id, turn, list_filter({_WORDS.format(c='text')}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS ws FROM conversations), x AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w), f AS (SELECT conv_id, turn, w, min(k) AS k FROM x GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS n FROM f)
SELECT c.conv_id, c.turn, coalesce(string_agg(g.w, ' ' ORDER BY g.n), '') AS keywords FROM conversations c LEFT JOIN g ON g.conv_id = c.conv_id AND g.turn = c.turn AND g.n <= 6 GROUP BY 1, 2""",
    "m14_select_passages": "WITH p AS (SELECT doc_id, k AS pos, string_split(text, chr(10))[k] AS p FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(k) WHERE trim(string_split(text, chr(10))[k]) <> ''), n AS (SELECT *, max(contains(lower(p), 'license')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM p), r AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM n WHERE near = 1 OR n <= 2) SELECT doc_id, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars FROM r WHERE upto <= 2000 GROUP BY 1",
    "m16_extract_numbers": "SELECT p_partkey, 0 AS k, p_size::DOUBLE AS value, 'km' AS unit, 'about' AS before FROM part UNION ALL SELECT p_partkey, 1, p_retailprice, NULL, 'price' FROM part UNION ALL SELECT p_partkey, 2, 1500.0 + p_size % 10 * 10, 'm', 'or' FROM part",
}
