"""Conversations and links: earlier questions for a new one, rewriting, citations, the strongest link, detected patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X

#: Words that say nothing about what a question is after.
FOCUS_STOP_WORDS = (
    "a", "about", "an", "and", "any", "are", "do", "does", "find", "for", "give", "how", "in", "is", "of", "on", "or", "show", "tell", "the", "to", "what", "when", "where", "who", "why",
)
#: Pronouns that stand for what was asked before.
PRONOUNS = r"(?i)\b(it|they|them|those|these|that|this|ones?|he|she|we|you)\b"
#: Kinds of lookup in the order in which they are tried: a name and a pattern whose first group is what is looked for.
LOOKUPS = (
    ("by_author", r"\b(?:by|authored by|written by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"),
    ("in_collection", r"(?i)\b(?:in|within|part of)\s+(?:the\s+)?[\"']?([\w -]{3,60}?)[\"']?\s+collection\b"),
    ("related_to", r"(?i)\b(?:related|similar) to\s+[\"']?([^\"'\n]{3,60})"),
    ("by_organization", r"\b(?:from|at|affiliated with)\s+((?:[A-Z][\w&.-]+\s*){1,6})"),
    ("by_tag", r"(?i)\btagged\s+(?:with\s+)?[\"']?([\w -]+)"),
    ("by_resource_type", r"(?i)\b(?:show|find|list|get|browse)\s+(?:me\s+)?(?:all\s+)?(datasets?|notebooks?|publications?|maps?)\b"),
)


def focus_words(text: Column, most: int = 6) -> Column:
    """The first different words of a question that mean something, in one line."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.array_join(F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*FOCUS_STOP_WORDS))), 1, most), " ")


def rewrite_with_context(earlier: Column, followup: Column, most: int = 12) -> Column:
    """A follow-up that stands alone: pronouns become the focus of the earlier questions, else the focus goes first; at most ``most`` words.

    ``earlier`` is an array of texts; without any the follow-up is only trimmed.
    """
    parts = F.transform(earlier, lambda q: F.coalesce(F.nullif(focus_words(q), F.lit("")), F.trim(q)))
    focus = F.array_join(F.filter(parts, lambda p: p != ""), " ; ")
    quoted = F.replace(F.replace(focus, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    merged = F.when(followup.rlike(PRONOUNS), F.regexp_replace(F.trim(followup), F.lit(PRONOUNS), quoted)).otherwise(F.concat_ws(" ", focus, F.trim(followup)))
    words = F.filter(F.split(merged, r"\s+"), lambda w: w != "")
    return F.when(F.coalesce(F.size(earlier), F.lit(0)) == 0, F.trim(followup)).otherwise(F.array_join(F.slice(words, 1, most), " "))


def select_relevant_context(history: DataFrame, thread: str, order: str, text: str, least: float = 0.35, most: int = 3) -> DataFrame:
    """(thread, asked, pos, cosine, rank): earlier texts of a thread nearest to its last one, by word vectors weighted by rarity.

    Only the last text of a thread is compared with the others, on shared words, so pairs grow with the texts
    and not with their square. Texts without words have no neighbours.
    """
    rows = history.select(F.col(thread).alias("thread"), F.col(order).alias("pos"), X.words(F.col(text)).alias("ws"))
    tf = rows.select("thread", "pos", F.explode("ws").alias("term")).groupBy("thread", "pos", "term").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select("thread", "pos", "term", (F.col("tf") * F.col("idf")).alias("w"))
    sizes = weighted.groupBy("thread", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    last = rows.groupBy("thread").agg(F.max("pos").alias("asked"))
    placed = weighted.join(last, "thread")
    new = placed.where("pos = asked").select("thread", "term", F.col("w").alias("v"))
    dots = placed.where("pos < asked").join(new, ["thread", "term"]).groupBy("thread", "asked", "pos").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    asked = sizes.select("thread", F.col("pos").alias("asked"), F.col("size").alias("asked_size"))
    scored = dots.join(sizes, ["thread", "pos"]).join(asked, ["thread", "asked"]).select("thread", "asked", "pos", F.round(F.col("dot") / (F.col("size") * F.col("asked_size")), 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("cosine"), "pos"))
    return scored.where(F.col("cosine") >= least).withColumn("rank", rank).where(F.col("rank") <= most).withColumnRenamed("thread", thread)


def platform_citations(text: Column, relations: dict[str, str]) -> Column:
    """Elements that a text links to: structs (element_id, rel, hint, host), each element and relation where it came first.

    ``relations`` gives the relation of each host. A link is host, a first path segment (the hint), and somewhere after it a UUID.
    """
    hosts = "|".join(h.replace(".", r"\.") for h in relations)
    pattern = rf"(?i)https?://({hosts})/([a-z_-]+)/(?:[^\s\"'<>]*?/)?([0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})"
    part = lambda m, k: F.lower(F.regexp_extract(m, pattern, k))
    rels = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(part(m, 3).alias("element_id"), part(m, 2).alias("hint"), part(m, 1).alias("host")))
    hits = F.transform(found, lambda z: F.struct(z["element_id"].alias("element_id"), F.element_at(rels, z["host"]).alias("rel"), z["hint"].alias("hint"), z["host"].alias("host")))
    same = lambda a, h: (a["element_id"] == h["element_id"]) & (a["rel"] == h["rel"])
    # a fold takes the links once; a filter would look for them again for each
    return F.aggregate(hits, F.filter(hits, lambda h: F.lit(False)), lambda kept, h: F.when(F.exists(kept, lambda a: same(a, h)), kept).otherwise(F.array_append(kept, h)))


#: Words at which a sentence turns, signs that may stand before them, and words that make a clause hypothetical.
TURN_WORDS, TURN_SIGNS = ("but", "however", "whereas"), ",;:\u2013\u2014"
HYPOTHETICAL_WORDS, HYPOTHETICAL_PHRASES = ("would", "could", "might"), ("for reference",)
#: Stands between clauses while they are apart; no text keeps one of its own.
_CUT = "\x01"


def strip_asides(text: Column) -> Column:
    """A text with its hypothetical clauses blanked to spaces of the same length, so that places in it stay what they were.

    A clause ends with a full stop, question or exclamation mark before white space, with a line, or before a word of
    TURN_WORDS and the sign ahead of it. It is hypothetical if it holds a word or phrase of those lists.
    """
    plain = F.translate(text, _CUT, " ")
    ended = F.regexp_replace(plain, r"[.!?]\s|\n", f"$0{_CUT}")
    turned = F.regexp_replace(ended, rf"(?i)[{TURN_SIGNS}]?\s*\b(?:{'|'.join(TURN_WORDS)})\b", f"{_CUT}$0")
    wanted = F.array(*[F.lit(w) for w in HYPOTHETICAL_WORDS])

    def shown(clause: Column) -> Column:
        said = X.words(clause)
        line = F.concat(F.lit(" "), F.array_join(said, " "), F.lit(" "))
        phrase = F.lit(False)
        for p in HYPOTHETICAL_PHRASES:
            phrase = phrase | F.contains(line, F.lit(f" {p} "))
        return F.when(F.arrays_overlap(said, wanted) | phrase, F.regexp_replace(clause, r"\S", " ")).otherwise(clause)

    return F.array_join(F.transform(F.split(turned, _CUT), shown), "")


def detect_lookup(query: Column, least: int = 2) -> Column:
    """Struct (name, value) of the first of LOOKUPS that finds at least ``least`` letters in a query, else null."""
    out = None
    for name, pattern in LOOKUPS:
        value = F.trim(F.regexp_extract(query, pattern, 1))
        hit = F.struct(F.lit(name).alias("name"), value.alias("value"))
        out = F.when(F.length(value) >= least, hit) if out is None else out.when(F.length(value) >= least, hit)
    return out


def best_of_pair(links: DataFrame, source: str, target: str, confidence: str, order: list[str]) -> DataFrame:
    """One link a pair: high before medium before any other confidence, then by ``order``. No window; the best is a minimum."""
    rank = F.when(F.col(confidence) == "high", 0).when(F.col(confidence) == "medium", 1).otherwise(2)
    rest = [c for c in links.columns if c not in (source, target)]
    best = links.groupBy(source, target).agg(F.min_by(F.struct(*rest), F.struct(rank, *order)).alias("best"))
    return best.select(source, target, "best.*")


def merge_lineage(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two edge tables, each edge once; merging again changes nothing."""
    return first.unionByName(second).distinct()


def keyword_score(fields: dict[str, float], term: Column) -> Column:
    """The weight of the best field that holds a term as a word, 0 if none does."""
    return F.greatest(F.lit(0.0), *[F.when(F.coalesce(X.term_hit(term, F.col(c)), F.lit(False)), F.lit(w)).otherwise(0.0) for c, w in fields.items()])


def spatial_search(points: DataFrame, box: tuple[float, float, float, float], fields: dict[str, float], term: str | None = None, kinds: tuple[str, list[str]] | None = None) -> DataFrame:
    """Every point in a box, of some kinds, that a keyword finds in a weighted field, with its score; no limit.

    ``box`` is xmin, ymin, xmax, ymax; ``kinds`` a column and its values. Without a term all score 0.
    """
    out = points.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if kinds:
        out = out.where(F.col(kinds[0]).isin(*kinds[1]))
    scored = out.withColumn("score", F.lit(0.0) if term is None else keyword_score(fields, F.lit(term)))
    return scored if term is None else scored.where("score > 0")
