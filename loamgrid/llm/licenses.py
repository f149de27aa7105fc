"""Licence scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard for expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from loamgrid.llm.batches import beside

#: Phrases and labels that every scan reports as base findings.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of this scan.
NOTICE_PHRASES = {
    "all rights reserved": "proprietary",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
}
#: How free a use is, by the beginning of a label; 0 would be no use at all.
OPENNESS = {
    "agpl": 0.35, "apache": 0.95, "bsd": 0.95, "cc-by": 0.85, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc0": 1.0,
    "gpl": 0.4, "isc": 0.95, "lgpl": 0.6, "mit": 0.95, "mpl": 0.65, "proprietary": 0.05, "public-domain": 1.0, "unlicense": 1.0,
}
UNKNOWN_OPENNESS, EXCEPTION_GAIN = 0.3, 0.2

TAG_WORDS, TAG = "spdx license identifier", re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_STRENGTH = {"with": 3, "and": 2, "or": 1}
#: Bytes of words are themselves, A-Z in lower case; all other ASCII bytes part words.
_WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def openness(label: str) -> float:
    """Of a label or identifier: the value of the longest known beginning."""
    known = [k for k in OPENNESS if label.startswith(k)]
    return OPENNESS[max(known, key=len)] if known else UNKNOWN_OPENNESS


def to_postfix(tokens: list[str]) -> list[str]:
    """Tokens of an expression in postfix order by a shunting-yard; ValueError where it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand_next:
                raise ValueError("an operator is missing")
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("an operand is missing")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("unbalanced")
            held.pop()
        elif low in _STRENGTH:
            if operand_next:
                raise ValueError("an operand is missing")
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("an operator is missing")
            out.append(low)
            operand_next = False
    if operand_next or "(" in held:
        raise ValueError("ends too early")
    return out + held[::-1]


@lru_cache(maxsize=4096)
def evaluated(expression: str) -> tuple[tuple[str, ...], float] | None:
    """Identifiers of an expression and its openness: or takes the freer side, and the stricter, with adds a little.

    Where words follow a well-formed beginning, the longest such beginning counts; None if there is none.
    """
    tokens = _TOKEN.findall(expression)
    for end in range(len(tokens), 0, -1):
        try:
            postfix = to_postfix(tokens[:end])
        except ValueError:
            continue
        stack: list[tuple[frozenset, float]] = []
        for token in postfix:
            if token not in _STRENGTH:
                stack.append((frozenset([token]), openness(token)))
                continue
            (right, rv), (left, lv) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, min(1.0, lv + EXCEPTION_GAIN)))
            else:
                stack.append((left | right, max(lv, rv) if token == "or" else min(lv, rv)))
        return tuple(sorted(stack[0][0])), stack[0][1]
    return None


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES, TAG_WORDS: ""}:
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None) -> dict:
    """Everything that the scan finds in one whole text; null counts as empty.

    ``spans`` has (start word, words, label) of each phrase found, ``expressions`` the tagged ones.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS_ONLY).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = sorted((end - size + 1, phrase) for end, (size, phrase) in _automaton().iter(line))
    spans, base, values, labels, at, word, tagged = [], [], [], set(), 0, 0, False
    for start, phrase in found:
        word += line.count(" ", at, start)
        at = start
        if phrase == TAG_WORDS:
            tagged = True
            continue
        label = BASE_PHRASES.get(phrase) or NOTICE_PHRASES[phrase]
        spans.append((word, phrase.count(" ") + 1, label))
        values.append(openness(label))
        labels.add(label)
        if phrase in BASE_PHRASES:
            base.append((word, label))
    expressions = []
    for m in TAG.finditer(text) if tagged else ():
        if got := evaluated(m[1]):
            labels.update(got[0])
            values.append(got[1])
            expressions.append(m[1].strip())
    return {
        "n_words": len(words), "n_base": len(base),
        "first_word": min((w for w, _ in base), default=None), "last_word": max((w for w, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted(labels)),
        "score": min(values, default=0.0), "spans": spans, "expressions": expressions,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word:long,words:long,label:string>>, expressions array<string>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and what ``scan_text`` finds (SCHEMA).

    score is the openness of the strictest finding, 0 where nothing is found. Each row is scanned whole and
    alone, so there is no shuffle and nothing that grows with a group.

    Defined cases: null and empty texts have no words, no labels ('') and score 0; null ids stay null;
    equal texts get equal values; an empty table gives an empty table.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(texts: list[str | None]) -> list[list]:
        found = [scan_text(t) for t in texts]
        return [[row[n] for row in found] for n in names]

    return beside(docs, [id_col], [text_col], SCHEMA, lambda: scan)
