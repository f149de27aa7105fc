import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamgrid.llm.packing import END_ID, WordIds, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS, WHOLE = WordIds(PATH, generation=50), Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


@given(st.lists(st.integers(1, 20_000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_pack_covers_everything_once(sizes):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pack(sizes):
        assert n > 0
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at
            at += n
        assert at == size
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_costs_are_balanced():
    spent = defaultdict(float)
    for _, _, n, s, _ in pack([700] * 50 + [60] * 400):
        spent[s] += n + n * n / 4096
    full = sorted(spent.values())[-10:]
    assert max(full) < 1.3 * min(full)


def plain_pack(sizes, length=4096):
    """The method by looking at every sequence for every document: (document, tokens, sequence) in order."""
    first = sum(size // length for size in sizes)
    rest = sorted(((size % length, doc) for doc, size in enumerate(sizes) if size % length), key=lambda r: (-r[0], r[1]))
    total = sum(n for n, _ in rest)
    room = [length] * (total // length) + [1 << k for k in range(total.bit_length(), -1, -1) if total % length >> k & 1]
    spent, out = [0.0] * len(room), []
    for n, doc in rest:
        while n:
            fits = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
            s = min(fits, key=lambda s: (spent[s], s))
            m = min(n, room[s])
            out.append((doc, m, first + s))
            room[s], spent[s], n = room[s] - m, spent[s] + m + m * m / 4096, n - m
    return out


@pytest.mark.parametrize("median", [60, 300, 900])
def test_only_what_no_sequence_holds_is_cut(median):
    sizes = np.maximum(1, np.random.default_rng(5).lognormal(np.log(median), 1.0, 600_000 // median)).astype(int).tolist()
    assert [(doc, n, s) for doc, start, n, s, _ in pack(sizes) if start >= sizes[doc] // 4096 * 4096] == plain_pack(sizes)


@given(st.text(st.sampled_from("aZéßÀİ.,!'$%_ \t\u0301１9tsreX－ŉ")))
@settings(max_examples=300, deadline=None)
def test_any_pieces_are_the_tokenizers(text):
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Don't stop, believin'!  x\n\ny\tz", "İstanbul ΣΑΣ é é ﬁ １２", "<|endoftext|> a", "", "\x1c\x85　wide line", "a" * 300])
def test_ids_by_words_are_the_tokenizers(text):
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    assert np.frombuffer(WordIds(PATH).encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_documents(odd_docs, docs_of):
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    rows = pack_documents(odd_docs.where("doc_id in (1, 2, 4, 7)"), PATH, pool=9000).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for i, parts in by_doc.items():
        ids = b"".join(bytes(r["ids"]) for r in sorted(parts, key=lambda r: r["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(texts[i] or "", add_special_tokens=False).ids, END_ID]
    assert by_doc[1][0]["doc_tokens"] == 1 and len(by_doc) == 4
    digests = pack_documents(odd_docs.where("doc_id = 3"), PATH, digest=True).collect()
    ids = np.asarray([*whole.encode("a", add_special_tokens=False).ids, END_ID], "<u4").tobytes()
    assert [(d["doc_tokens"], d["ids_crc32"]) for d in digests] == [(2, zlib.crc32(ids))] * 2
    assert pack_documents(docs_of([]), PATH).count() == 0
