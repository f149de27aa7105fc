"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Method: each document's cost is estimated as linear plus quadratic (attention) in its tokens; documents
go in descending order to the sequence with the lowest cost that still has room.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql import types as T
from tokenizers import Tokenizer

LENGTH, END_ID = 4096, 2
#: Tokens that are gathered in a task before they are packed; more leaves less padding, fewer holds less memory.
POOL = 1_500_000
#: Weights of the cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1 / 4096


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Token ids of pieces between white space, as little-endian 32-bit bytes, by piece; looks up what it doesn't hold.

    The vocabulary drops white space and never merges over it, so a text's ids are those of its pieces in a
    row. Only ASCII blanks part pieces here: what else Unicode calls white space is left to the tokenizer.
    A piece of Latin-1 letters and then signs without an apostrophe has two words by the tokenizer's rules,
    which go straight to its merges; any other piece goes through the whole tokenizer.

    Pieces are remembered in two generations: the older one is forgotten when the younger is full, and what
    is met again moves to the younger, so frequent pieces stay and memory is bounded. The word of a piece is
    a piece of its own, so that it is merged once for all capitals and signs around it.
    """

    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, generation: int = 200_000):
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.simple = self.tokenizer.model.tokenize, self.SIMPLE.fullmatch
        self.letters = _byte_letters()
        self.generation = generation
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if (parts := self.simple(piece)) is None:
                ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            else:
                word, signs = parts.groups()
                lower = word.lower()
                if signs and word:
                    ids = self[lower] + self[signs]
                elif lower != piece and word:
                    ids = self[lower]
                else:
                    letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                    ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty."""
        if len(self) > self.generation:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents with ``sizes`` tokens.

    Whole runs of ``length`` are cut off and fill sequences of their own. The rest, in descending order,
    goes to the sequence of the lowest cost among those that hold it whole; only what none can hold is cut, to
    fill those of the lowest cost. Sequences are as few as the tokens allow, and what is left for the last is cut
    into powers of two, which need no padding.
    """
    out, sequence, rest = [], 0, []
    for doc, size in enumerate(sizes):
        full = size // length
        for k in range(full):
            out.append((doc, k * length, length, sequence, 0))
            sequence += 1
        if size % length:
            rest.append((size % length, doc, full * length))
    total = sum(r[0] for r in rest)
    lengths = [length] * (total // length)
    left = total % length
    while left:  # the last sequences: each a power of two
        lengths.append(1 << (left.bit_length() - 1))
        left -= lengths[-1]
    used, spent = [0] * len(lengths), [0.0] * len(lengths)
    # sequences with room for the document at hand, by cost, and those without, by room; sizes only fall,
    # so what is set aside comes back once, when a document is small enough for it
    heap = [(0.0, s) for s in range(len(lengths))]
    aside: list[tuple[int, int]] = []
    heapq.heapify(heap)

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, sequence + s, used[s]))
        used[s] += n
        spent[s] += cost(n)

    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            while aside and -aside[0][0] >= n:
                _, s = heapq.heappop(aside)
                heapq.heappush(heap, (spent[s], s))
            while heap and lengths[heap[0][1]] - used[heap[0][1]] < n:
                _, s = heapq.heappop(heap)
                heapq.heappush(aside, (used[s] - lengths[s], s))
            if heap:
                _, s = heapq.heappop(heap)
            else:  # no room for the whole anywhere: cut it, lowest cost first
                entry = min(aside, key=lambda e: (spent[e[1]], e[1]))
                aside.remove(entry)
                heapq.heapify(aside)
                s = entry[1]
            m = min(n, lengths[s] - used[s])
            put(doc, start, m, s)
            start, n = start + m, n - m
            if used[s] < lengths[s]:
                heapq.heappush(heap, (spent[s], s))
    return out


PIECE_FIELDS = [
    StructField("start", T.LongType()), StructField("length", T.LongType()), StructField("ids", T.BinaryType()),
    StructField("doc_tokens", T.LongType()), StructField("sequence_id", T.LongType()), StructField("offset", T.LongType()),
    StructField("sequence_cost", T.DoubleType()),
]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pool: int = POOL, digest: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, ids (bytes), doc_tokens, sequence_id, offset, sequence_cost.

    ``tokenizer`` is the path of the vocabulary file, which every executor has; ids of a document are those of
    its whole text and END_ID. With ``digest`` the ids are given as ``ids_crc32`` instead. Each task tokenises
    its part of the input and packs it in pools of about ``pool`` tokens, so nothing is shuffled, memory is
    bounded, and a lost task is simply done again. A sequence's id is its task's number times 2^32 plus a count.

    Defined cases: null and empty texts are documents of one token (END_ID); repeated rows are packed each;
    a null id stays null; a text longer than a sequence is cut; an empty table gives an empty table.
    """
    last = StructField("ids_crc32", T.LongType())
    fields = [last if digest and f.name == "ids" else f for f in PIECE_FIELDS]
    schema = StructType([docs.schema[id_col], *fields])
    types = [f.type for f in to_arrow_schema(schema)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, tokens, next_sequence, base = WordIds(tokenizer), [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            pieces = pack([len(ids) // 4 for _, ids in held], length)
            costs: dict[int, float] = {}
            for _, _, n, s, _ in pieces:
                costs[s] = costs.get(s, 0.0) + cost(n)
            out = []
            for d, start, n, s, offset in pieces:
                name, ids = held[d]
                part_ids = ids[4 * start : 4 * (start + n)]
                out.append((name, start, n, zlib.crc32(part_ids) if digest else part_ids, len(ids) // 4, base + next_sequence + s, offset, costs[s]))
            next_sequence += 1 + max(p[3] for p in pieces)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)

        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            base = batch.column("part")[0].as_py() << 32 if batch.num_rows else base
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode(text) + end
                held.append((name, ids))
                tokens += len(ids) // 4
                if tokens >= pool:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return rows.mapInArrow(packed, schema)

