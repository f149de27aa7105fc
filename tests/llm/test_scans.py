import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from loamgrid.llm import licenses as L
from loamgrid.llm.sentencepieces import SPACE, Pieces, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("text", ["Under the GNU General-Public LICENSE, and apache license; CC BY-NC cc by", "mit license" * 3, "mitlicense MIT\nlicense, MIT  License é", "", None, "cc cc by by cc by cc by"])
def test_base_places(text):
    words = plain_words(text)
    places = sorted((k, label) for phrase, label in L.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    got = L.scan_text(text)
    assert got["n_words"] == len(words) and got["n_base"] == len(places)
    assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert got["base_labels"] == ",".join(sorted({p[1] for p in places}))
    assert {p[1] for p in places} <= set(got["labels"].split(",")) | {""}


@pytest.mark.parametrize(
    ("expression", "labels", "value"),
    [("MIT", ("mit",), 0.95), ("(MIT OR GPL-2.0-only) AND Apache-2.0", ("apache-2.0", "gpl-2.0-only", "mit"), 0.95), ("GPL-2.0+ WITH Classpath-exception-2.0", ("gpl-2.0+",), 0.6), ("MIT AND GPL-3.0-only OR CC0-1.0", ("cc0-1.0", "gpl-3.0-only", "mit"), 1.0), ("MIT and then some", ("mit", "then"), 0.3), ("OR", None, None), (") (", None, None)],
)
def test_expressions(expression, labels, value):
    got = L.evaluated(expression)
    assert got is None if labels is None else got[0] == labels and got[1] == pytest.approx(value)


def test_tags_in_texts():
    got = L.scan_text("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode")
    assert got["labels"] == "apache-2.0,mit" and got["expressions"] == ["MIT OR Apache-2.0"] and got["score"] == 0.95


def test_scan_rows(odd_docs, docs_of):
    rows = L.scan_licenses(odd_docs).collect()
    assert len(rows) == 9 and all(r["score"] == 0 for r in rows)
    assert L.scan_licenses(docs_of([])).count() == 0


# ---- pieces


def plain_viterbi(pieces, word):
    """The best segmentation by trying all, one position after the other."""
    ids = {pieces.pieces[i]: i for i in pieces.ids.tolist()}
    scores = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - pieces.longest), end):
            i = ids.get(word[start:end])
            gain = scores[i] if i is not None else pieces.unknown if end - start == 1 else None
            if gain is not None and (best[end] is None or best[start][0] + gain > best[end][0]):
                best[end] = (best[start][0] + gain, best[start][1] + [(i, word[start:end])])
    return best[-1][0], [j for i, part in best[-1][1] for j in ([i] if i is not None else [pieces.bytes_at[b] for b in part.encode()])]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL, remember=100)


def test_against_plain_viterbi(pieces):
    words = ["Hello", "internationalisation", "ünï", "１２３", "𝒳y", "a" * 40, "x_y-z", "the", "  a"]
    for w in words:
        marked = SPACE + w.replace(" ", SPACE)
        score, ids = plain_viterbi(pieces, marked) if SPACE not in marked[1:] else (None, None)
        got, total, _ = pieces.encode([w])[0]
        if ids is not None:
            assert np.frombuffer(got, "<u4").tolist() == ids and total == score


def patched_to_unigram(path, out):
    """The model file with its type set to unigram and its lowest scores lifted, so that the library's 32-bit sums stay exact."""
    import struct

    def varint(b, i):
        r = s = 0
        while True:
            x = b[i]
            i += 1
            r |= (x & 127) << s
            s += 7
            if x < 128:
                return r, i

    def enc(v):
        o = b""
        while v > 127:
            o += bytes([v & 127 | 128])
            v >>= 7
        return o + bytes([v])

    def fields(b):
        i = 0
        while i < len(b):
            k, i = varint(b, i)
            if k & 7 == 0:
                v, i = varint(b, i)
            else:
                n, i = (varint(b, i)) if k & 7 == 2 else (4, i)
                v, i = b[i : i + n], i + n
            yield k >> 3, k & 7, v

    def put(f, w, v):
        return enc(f << 3 | w) + (enc(v) if w == 0 else enc(len(v)) + v if w == 2 else v)

    data = b""
    for f, w, v in fields(open(path, "rb").read()):
        if f in (1, 2):
            inner = b""
            for a, ww, c in fields(v):
                if f == 2 and a == 3:
                    c = 1
                if f == 1 and ww == 5:
                    c = struct.pack("<f", max(struct.unpack("<f", c)[0], -33000.0))
                inner += put(a, ww, c)
            v = inner
        data += put(f, w, v)
    open(out, "wb").write(data)
    return out


def test_against_the_library_in_unigram_mode(tmp_path):
    path = patched_to_unigram(MODEL, str(tmp_path / "unigram.model"))
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    texts = ["Hello  world\n\tx", "  a", "", " ", "ünï ﬁ １２３", "a▁b", "𝒳 y", "The quick brown fox, jumping over 13 lazy dogs.", "trailing  "]
    for t, (ids, _, _) in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert ours.decode(ids) == t.replace(SPACE, " ")


def test_a_very_long_word(pieces):
    """Places of a long word are looked up in strides; memory of words turns over and gives the same."""
    word = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(200_000))
    ids, _, good = pieces.encode([word])[0]
    assert good and pieces.decode(ids) == word
    short = SPACE + word[:3000]
    score, plain = plain_viterbi(pieces, short)
    got, total, _ = pieces.encode([word[:3000]])[0]
    assert np.frombuffer(got, "<u4").tolist() == plain and total == pytest.approx(score, abs=1e-6)
    texts = [f"{word[k : k + 60]} {word[2 * k : 2 * k + 9]}{k} the" for k in range(120)]
    one_by_one = [pieces.encode([t])[0] for t in texts]
    assert one_by_one == pieces.encode(texts) and pieces.older


def test_documents_round_trip(odd_docs, docs_of):
    rows = encode_documents(odd_docs, MODEL).collect()
    assert len(rows) == 9 and all(r["round_trip"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert encode_documents(docs_of([]), MODEL, digest=True).columns == ["doc_id", "ids_crc32", "n_tokens", "score", "round_trip"]
