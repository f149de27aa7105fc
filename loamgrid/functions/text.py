"""Text as columns: tokens, crude stems, keys, links, numbers. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "show", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "will", "with",
)
#: Query parameters that only track where a visitor came from, by name and by beginning.
TRACKING = (
    "_hsenc", "_hsmi", "campaign_id", "cmpid", "dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "referrer", "source", "spm", "yclid",
)
TRACKING_BEGINNINGS = ("ga_", "mtm_", "pk_", "utm_")
#: Beginnings of a follow-up question, and words and pronouns that lean on an earlier one.
FOLLOW_UPS = (
    r"(?i)^\s*(similarly|in addition|like before|as well|what about|what else|any other|how about|more about)\s"
    r"|(^|\s)(also|and|another|any|else|more|others|similarly)(\s|$)"
    r"|\b(he|it|ones?|she|that|them|these|they|this|those|we|you)\b"
)


def identifier_tokens(text: Column) -> Column:
    """Lower-case tokens of identifiers: runs of letters and digits, whole and parted at camel humps."""
    whole = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    humps = F.flatten(F.transform(whole, lambda w: F.regexp_extract_all(w, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))))
    return F.array_distinct(F.transform(F.concat(whole, humps), F.lower))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem_plural(word: Column) -> Column:
    """Plural endings off: ies to y, es after sibilants, s but not ss."""
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(s|x|z|ch|sh)es$") & (F.length(word) > 4), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def stem_crude(word: Column) -> Column:
    """ing, ies, es and s endings off words long enough to keep four letters."""
    return (
        F.when(word.rlike("ing$") & (F.length(word) >= 7), F.regexp_replace(word, "ing$", ""))
        .when(word.rlike("ies$") & (F.length(word) >= 6), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("es$") & (F.length(word) >= 6), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$") & (F.length(word) >= 5), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


#: Endings that the longest of the stemmers takes off, tried in this order.
LONG_ENDINGS = ("ings", "ing", "edly", "ed", "ies", "ied", "es", "s", "tions", "tion", "ally", "ment")


def stem_long(word: Column) -> Column:
    """The first fitting ending of LONG_ENDINGS off where three letters stay, then one of a doubled last consonant of words over three."""
    cut = F.when(F.lit(False), word)
    for end in LONG_ENDINGS:
        cut = cut.when(word.endswith(end) & (F.length(word) >= len(end) + 3), F.substring(word, F.lit(1), F.length(word) - len(end)))
    cut = cut.otherwise(word)
    doubled = (F.length(cut) > 3) & cut.rlike(r"([^aeiou])\1$")
    return F.when(doubled, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def meaningful_terms(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS)))


def term_hit(term: Column, text: Column) -> Column:
    """Whether a stem occurs at the start of a word, with at most s, es, ing or ed after it."""
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}])"), term, F.lit(r"(s|es|ing|ed)?($|[^\p{L}\p{N}])")))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters."""
    base = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    kept = F.filter(F.split(F.regexp_extract(base, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING) & ~F.lower(p).rlike(f"^({'|'.join(TRACKING_BEGINNINGS)})"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(head, F.when(path == "", "/").otherwise(path), query)


def blob_to_raw(url: Column) -> Column:
    """A code host's page of a file to the address of its bytes."""
    return F.regexp_replace(url, r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def dois(text: Column) -> Column:
    """Distinct DOIs, lower case, without what closes a sentence or bracket."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(10\.\d{4,9}/[^\s\"<>]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;:)\]}]+$", "")))


def author_key(name: Column) -> Column:
    """A name that two records spell alike: without a leading "and" or "&", other punctuation than dots and dashes, case and repeated blanks."""
    told = F.regexp_replace(F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n\r")), r"(?i)^(?:and|&)\s+", "")
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(told, r"[^\p{L}\p{N}_\s.-]", ""))), r"\s+", " ")


def sanitize_tag(text: Column, most: int = 128) -> Column:
    """A text as the value of a storage tag: every character but ASCII letters, digits, blanks and + - = . _ : / becomes _, cut at ``most``."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9+=._:/ -]", "_"), 1, most)


def slug(text: Column, most: int = 64) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")


def error_class(text: Column) -> Column:
    """The leading error or exception name of a message, else "error"."""
    got = F.regexp_extract(text, r"^\s*([A-Za-z_.]*(?:Error|Exception))\b", 1)
    return F.when(got == "", "error").otherwise(F.element_at(F.split(got, r"\."), -1))


#: Parts of a page that hold what it is about, the better first.
MAIN_PARTS = ("main", "article")


def html_to_text(html: Column) -> Column:
    """Visible text, of the main part or else the article where a page has one: comments, scripts, styles and the like dropped, blocks on lines of their own, entities of the basic set."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    inner = F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit("")) for tag in MAIN_PARTS])
    t = F.coalesce(inner, t)
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|svg|nav|header|footer|form|head)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|main|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f\x0b]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.btrim(t, F.lit("\n ")))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def paragraph_chunks(text: Column, most: int) -> Column:
    """Paragraphs packed in order into chunks of at most ``most`` characters; one longer paragraph is a chunk of its own."""
    start = F.array().cast("array<string>")
    last = lambda acc: F.element_at(acc, -1)

    def add(acc: Column, p: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + 2 + F.length(p) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), F.lit("\n\n"), p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""), start, add)


def numbers_in(text: Column) -> Column:
    """Numbers of a text as structs: value, the unit right after it if it is a known one, the word before."""
    pattern = r"(?:(\p{L}+)\s+)?(-?\d[\d,]*(?:\.\d+)?)\s*(km2|km|mi|m|ft|ha|%|degrees)?\b"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("w"), part(2).alias("n"), part(3).alias("u")), lambda z: F.struct(F.replace(z["n"], F.lit(","), F.lit("")).try_cast("double").alias("value"), F.nullif(z["u"], F.lit("")).alias("unit"), F.nullif(z["w"], F.lit("")).alias("before")))
