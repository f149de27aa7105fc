"""Lookups, scores and classes by words, names, tags and hosts that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.pairs import paired


#: What is served in place of a document, and phrases that tell it, the first kind that fits counts.
SERVED_INSTEAD = {
    "a bot-check page": ["confirm you are a human", "are you a robot", "verify you are human", "enable javascript and cookies", "checking your browser", "ticking the box below", "cf-browser-verification"],
    "a paywall or login page": ["purchase access", "institutional login", "sign in to continue", "subscribe to view", "get access to this article", "you do not have access"],
    "an error page": ["404 not found", "page not found", "403 forbidden", "service unavailable", "we apologize for the inconvenience"],
    "a cookie consent page": ["we use cookies", "accept all cookies", "cookie preferences"],
}
#: Outcomes of reading a file and phrases of the reader's reason that tell them, in the order in which they are tried.
REACH = {
    "wall": ["bot-check", "paywall", "cookie consent", "error page"], "empty": ["empty (0 bytes)"], "no text": ["no text layer"],
    "wrong type": ["zip archive", "no reader for extension", "carried no extractable text"], "broken": ["could not parse", "not installed", "could not be opened"],
}
#: Causes of findings by the check that found them and an expression for its message, in the order in which they are tried.
CAUSES = (
    ("gate:count_population", "exceeds every frame", "a count that isn't of rows"), ("gate:count_population", "", "count check: other"),
    ("gate:declared_units", "fractional", "a mean read as a count"), ("gate:declared_units", "unrecognised unit", "a unit not in the vocabulary"), ("gate:declared_units", "", "declared unit missing or unparseable"),
    ("gate:projected_crs", r"\.(?:area|length)\s*>\s*0\b", "a test for non-zero size"), ("gate:projected_crs", r"print\(", "a printed size"), ("gate:projected_crs", "", "a metric operation on a geographic CRS"),
    ("gate:", "", "another gate"), ("audit", "", "a claim outside the record"), ("number_scan", "", "a number that isn't resolved"), ("agreement", "", "runs disagree"),
)


def reach_bucket(reason: Column, chars: Column) -> Column:
    """What became of reading a document, from the reader's reason and how many characters it got; a reason that is only a note beside a text is readable."""
    low, some = F.lower(F.coalesce(reason, F.lit(""))), F.coalesce(chars, F.lit(0)) > 0
    out = F.when((low == "") & some, "readable")
    for bucket, phrases in REACH.items():
        out = out.when(held(low, phrases) > 0, bucket)
    return out.when(some, "readable").otherwise("wrong type")


def finding_cause(check: Column, message: Column, rules: tuple[tuple[str, str, str], ...] = CAUSES, other: str = "unattributed") -> Column:
    """The cause of the first rule (check, message expression, cause) that fits; a check that ends with a colon stands for all that begin so."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern, cause in rules:
        fits = check.startswith(name) if name.endswith(":") else check == name
        out = out.when(fits & F.coalesce(message, F.lit("")).rlike(pattern) if pattern else fits, cause)
    return out.otherwise(other)


class NoSuchCategory(ValueError):
    """A category or kind that no row has; the message names kinds that there are."""


def category_filter(df: DataFrame, column: str, name: str, categories: dict[str, list[str]], named: int = 40) -> DataFrame:
    """Rows of the kinds that a category stands for, or of the kind of that name, letter case and blanks at the ends aside.

    Nothing found is an error that names up to ``named`` of the kinds that there are.
    """
    key = name.strip().upper()
    kinds = {k.upper(): [x.upper() for x in v] for k, v in categories.items()}.get(key, [key])
    out = df.where(F.upper(F.col(column).cast("string")).isin(*kinds))
    if not out.limit(1).count():
        there = [r[0] for r in df.select(F.upper(F.col(column).cast("string")).alias("k")).where("k is not null").distinct().orderBy("k").limit(named).collect()]
        raise NoSuchCategory(f"{name!r} matches no row; categories: {sorted(categories)}; kinds: {there}")
    return out


def held(text: Column, terms: list[str]) -> Column:
    """How many of ``terms`` a text holds, letter case aside; 0 for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def vocabulary_score(text: Column, strong: list[str], medium: list[str], foreign: list[str]) -> Column:
    """3 for each strong word of the domain, 1 for each medium one, -2 for each of another domain."""
    return held(text, strong) * 3 + held(text, medium) - held(text, foreign) * 2


def keyword_graph_rank(docs: DataFrame, item: str, title: str, body: str, use: DataFrame, terms: list[str]) -> DataFrame:
    """(item, score) of rows that hold any term: 2 a term of the title, 1 of the body, 0.2 log10(clicks + 1), 0.05 a neighbour.

    ``use`` has (item, clicks, degree); rows that it doesn't have count as 0.
    """
    hits = docs.select(item, held(F.col(title), terms).alias("a"), held(F.col(body), terms).alias("b")).where("a + b > 0")
    n = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("a") * 2 + F.col("b") + F.log10(n("clicks") + 1) * 0.2 + n("degree") * 0.05
    return hits.join(use, item, "left").select(item, score.alias("score"))


def author_lookup(works: DataFrame, people: DataFrame, on: str, name: str, part: str, public: Column, clicks: Column, weight: float = 0.3) -> DataFrame:
    """Works of the public contributors whose name holds ``part``, with ``score``: ``weight`` times log10(clicks + 1)."""
    found = people.where(F.contains(F.lower(name), F.lit(part.lower())) & public)
    return works.join(found, on).withColumn("score", F.log10(clicks + 1) * weight)


def lookups(items: DataFrame, finds: dict[str, Column], bonus: dict[str, float], names: str | None = None) -> DataFrame:
    """Items that any of the named lookups finds, in one pass, with ``score``: the sum of the bonuses of those that do.

    With ``names`` a column of that name lists the lookups that found an item.
    """
    hit = {k: F.coalesce(c, F.lit(False)) for k, c in finds.items()}
    anywhere = F.lit(False)
    for c in hit.values():
        anywhere = anywhere | c
    score = sum((F.when(hit[k], float(b)).otherwise(0.0) for k, b in bonus.items()), F.lit(0.0))
    out = items.where(anywhere).withColumn("score", score)
    return out.withColumn(names, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in hit.items()]))) if names else out


def link_kind(url: Column, suffixes: dict[str, list[str]]) -> Column:
    """The first kind of which a host suffix fits the link's host, on whole labels; else direct."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    kind = F.when(F.lit(False), F.lit(""))
    for k, ends in suffixes.items():
        for end in ends:
            kind = kind.when((host == end) | host.endswith("." + end), k)
    return kind.otherwise("direct")


def page_kind(text: Column, phrases: dict[str, list[str]], most: int = 4000) -> Column:
    """The first kind of which a text of at most ``most`` characters holds a phrase; longer and other texts are documents."""
    short = F.length(text) <= most
    kind = F.when(F.lit(False), F.lit(""))
    for k, words in phrases.items():
        kind = kind.when(short & (held(text, words) > 0), k)
    return kind.otherwise("document")


def term_coverage(docs: DataFrame, by: str, text: str, terms: list[str], chars: int = 600) -> DataFrame:
    """(by, coverage, n): the share of documents whose first ``chars`` characters hold a term, to two places."""
    hit = held(F.substring(text, 1, chars), terms) > 0
    return docs.groupBy(by).agg(F.round(F.avg(hit.cast("double")), 2).alias("coverage"), F.count("*").alias("n"))


def themes_grounded(docs: DataFrame, group: str, text: str, words: list[str], least: float = 0.7) -> DataFrame:
    """(group, share, grounded): the share of a theme's words that a group's texts hold, and whether it is ``least`` or more."""
    found = F.array(*[F.max(held(F.col(text), [w])) for w in words])
    share = F.aggregate(found, F.lit(0), lambda s, v: s + v) / F.lit(float(len(words)))
    return docs.groupBy(group).agg(F.round(share, 6).alias("share"), (share >= least).alias("grounded"))


def census(elements: DataFrame, kind: Column, private: Column) -> DataFrame:
    """(kind, n) of the elements that aren't private; a null mark isn't private."""
    return elements.where(~F.coalesce(private, F.lit(False))).groupBy(kind).agg(F.count("*").alias("n"))


#: Names too general to tell a unit by.
GENERIC_NAMES = ("analyze", "build", "compute", "data", "get", "load", "main", "make", "map", "model", "plot", "process", "read", "run", "set", "test", "train")


def tool_names(tool: Column) -> Column:
    """Names that a tool in a text may go by: what follows its last dot up to a bracket, what stands in brackets (also joined by underscores), and all of it so joined.

    Names under four characters and general ones are left out.
    """
    text = F.trim(F.coalesce(tool, F.lit("")))
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]{2,40})\)"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    joined = F.transform(inner, lambda x: F.replace(F.replace(x, F.lit("-"), F.lit("")), F.lit(" "), F.lit("_")))
    last = F.lower(F.trim(F.regexp_replace(F.element_at(F.split(text, r"\."), -1), r"\([^(]*$", "")))
    names = F.concat(F.array(last), inner, joined, F.array(F.replace(F.lower(text), F.lit(" "), F.lit("_"))))
    return F.array_distinct(F.filter(names, lambda x: (F.length(x) >= 4) & ~x.isin(*GENERIC_NAMES)))


def spec_unit_links(specs: DataFrame, units: DataFrame, spec: str, tools: str, unit: str, symbol: str, ambiguous: Column, alias: Column) -> DataFrame:
    """(spec, unit, matched, confidence): units whose whole symbol is a name of a tool that a spec refers to, once for each unit, with confidence low.

    Units that are marked ambiguous or as an alias take no part. Where several names find a unit, the smallest counts;
    pairs are grouped for that only of units that have several symbols.
    """
    good = units.where(~F.coalesce(ambiguous, F.lit(False)) & ~F.coalesce(alias, F.lit(False))).select(unit, F.lower(F.trim(symbol)).alias("matched")).where("matched <> ''")
    asked = specs.select(spec, F.explode(tools).alias("tool")).select(spec, F.explode(tool_names(F.col("tool"))).alias("matched")).distinct()
    asked_for = good.join(asked.select("matched").distinct(), "matched", "left_semi")
    symbols = asked_for.groupBy(unit).agg(F.min("matched").alias("least"), F.max("matched").alias("most"))
    one = paired(asked, symbols.where("least = most").select(unit, F.col("least").alias("matched")), "matched", spec, unit)
    several = asked_for.join(symbols.where("least <> most").select(unit), unit, "left_semi").distinct()
    least = paired(asked, several, "matched", spec, unit).groupBy(spec, unit).agg(F.min("matched").alias("matched"))
    return one.select(spec, unit, "matched").unionByName(least).withColumn("confidence", F.lit("low"))


def cited_doi_links(elements: DataFrame, specs: DataFrame, element: str, text: str, spec: str, doi: str, found: Column) -> DataFrame:
    """(spec, element, doi, confidence): elements whose text names a spec's DOI, with confidence high; a spec's own element is left out.

    ``found`` is the column of DOIs in ``text``.
    """
    cited = elements.select(element, F.explode(found).alias("__doi")).distinct()
    known = specs.select(spec, F.lower(doi).alias("__doi"))
    pairs = cited.join(known, "__doi").where(F.col(spec) != F.col(element))
    return pairs.select(spec, element, F.col("__doi").alias("doi"), F.lit("high").alias("confidence"))
