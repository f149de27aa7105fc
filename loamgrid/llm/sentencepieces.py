"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Method: the distinct words of a batch are sorted by length, and words of equal length advance together;
hashes of their substrings probe the sorted keys of the pieces, and the maxima over all pieces that end at
a position store backpointers. Pieces with the highest total score win (unigram segmentation), ties go
to the longer last piece; characters without a piece fall back to bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from loamgrid.llm.batches import beside, transposed

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A word: a run of marked blanks and what follows up to the next; no piece but runs of blanks crosses its edge.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Substrings that are looked up at a time; characters of the texts that are encoded together.
PROBES, TOGETHER = 400_000, 1_500_000
#: How far below the lowest normal score a character without a piece lies.
UNKNOWN_PENALTY = 10.0


def _codes(words: list[str]) -> np.ndarray:
    """Mixed code points of words of one length, a row a word."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)
    raw = (raw + np.uint64(1)) * _MIX
    return raw ^ (raw >> np.uint64(31))


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings, modulo 2^64."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + codes[:, k]
    return out


class Pieces:
    """The pieces of one model as sorted hash keys, and a bounded memory of words already encoded."""

    def __init__(self, path: str, remember: int = 150_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in normal}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.longest = max(len(self.pieces[i]) for i in normal)
        keys, ids = [], []
        for size in sorted({len(self.pieces[i]) for i in normal}):
            same = [i for i in normal if len(self.pieces[i]) == size]
            keys.append(_prefix_hashes(_codes([self.pieces[i] for i in same]))[:, -1])
            ids.append(np.array(same))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash key")
        self.scores = np.array([scores[i] for i in self.ids.tolist()])
        self.first_bits = np.zeros(1 << 21, bool)  # whether any key begins with these bits: most probes end here
        self.first_bits[self.keys >> np.uint64(43)] = True
        self.out = [bytes([int(p[3:5], 16)]) if i in self.bytes_at.values() else b"" if model.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.known: dict[str, tuple[bytes, float, bool]] = {}
        self.older: dict[str, tuple[bytes, float, bool]] = {}
        self.remember = remember

    def _probe(self, h: np.ndarray, first: int, last: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf: no piece) and ids of what ends at places ``first`` to ``last``, by word, place and length from ``longest`` down."""
        ends, lengths = np.arange(first, last + 1), np.arange(longest, 0, -1)
        starts = ends[:, None] - lengths
        power = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(longest, BASE)])
        key = (h[:, ends, None] - h[:, np.maximum(starts, 0)] * power[lengths]).ravel()
        shape = (len(h), *starts.shape)
        there = np.flatnonzero(self.first_bits[key >> np.uint64(43)] & np.broadcast_to(starts >= 0, shape).ravel())
        at = np.minimum(np.searchsorted(self.keys, key[there]), len(self.keys) - 1)
        hit = self.keys[at] == key[there]
        gain, names = np.full(len(key), -np.inf), np.zeros(len(key), np.int32)
        gain[there[hit]], names[there[hit]] = self.scores[at[hit]], self.ids[at[hit]]
        gain = gain.reshape(shape)
        gain[:, :, -1] = np.where(np.isfinite(gain[:, :, -1]), gain[:, :, -1], self.unknown)
        return gain, names.reshape(shape)

    def _same_length(self, words: list[str]) -> None:
        """The best segmentations of words of one length, all words at once."""
        n, size = len(words), len(words[0])
        h, longest, rows = _prefix_hashes(_codes(words)), min(self.longest, size), np.arange(n)
        best, back, piece = np.zeros((n, size + 1)), np.zeros((n, size + 1), np.int32), np.zeros((n, size + 1), np.int32)
        stride = max(1, PROBES // (n * longest))
        for first in range(1, size + 1, stride):
            last = min(size, first + stride - 1)
            gain, names = self._probe(h, first, last, longest)
            for end in range(first, last + 1):
                skip = max(0, longest - end)  # lengths that would begin before the word
                total = best[:, end - longest + skip : end] + gain[:, end - first, skip:]
                top = total.argmax(axis=1)
                best[:, end], back[:, end], piece[:, end] = total[rows, top], end - longest + skip + top, names[rows, end - first, skip + top]
        at, steps = np.full(n, size), []
        while at.any():
            steps.append(np.where(at > 0, piece[rows, at], -1))
            at = back[rows, at]
        chosen = np.stack(steps[::-1], axis=1)
        real, with_bytes = chosen >= 0, (chosen == 0).any(axis=1)
        ends = (4 * np.cumsum(real.sum(axis=1))).tolist()
        raw = chosen[real].astype("<u4").tobytes()
        for k, (word, begin, end, value) in enumerate(zip(words, [0, *ends[:-1]], ends, best[:, size].tolist(), strict=True)):
            ids = self._with_bytes(word, chosen[k][real[k]].tolist()) if with_bytes[k] else raw[begin:end]
            self.known[word] = (ids, value, self.joined(ids) == word.replace(SPACE, " "))

    def _with_bytes(self, word: str, row: list[int]) -> bytes:
        out, at = [], 0
        for i in row:
            if i:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.bytes_at[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, float, bool]]:
        """(ids as little-endian 32-bit bytes, their total score, whether decoding gives the text back) of each whole text.

        Null and empty texts have no ids. A text is its words in a row, so each distinct word is decoded once.
        """
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        by_length: dict[int, list[str]] = {}
        for word in set().union(*split).difference(self.known):
            if word in self.older:
                self.known[word] = self.older[word]
            else:
                by_length.setdefault(len(word), []).append(word)
        for size, words in by_length.items():
            step = max(1, PROBES // (size * min(size, self.longest)))
            for k in range(0, len(words), step):
                self._same_length(words[k : k + step])
        out = []
        for words in split:
            ids, values, good = zip(*map(self.known.__getitem__, words), strict=True) if words else ((), (), ())
            out.append((b"".join(ids), sum(values), all(good)))
        return out

    def joined(self, ids: bytes) -> str:
        """The text of ids with all its blanks."""
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(SPACE, " ")

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank that encoding put first is taken off again."""
        return self.joined(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


SCHEMA = "ids {0}, n_tokens long, score double, round_trip boolean"


def _together(texts: list[str | None]) -> Iterator[slice]:
    """Slices of ``texts`` with about TOGETHER characters each."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= TOGETHER or k == len(texts) - 1:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, ids, n_tokens and score by Viterbi, and whether decoding gives the text back.

    Ids are bytes; with ``digest`` their CRC-32 stands in ``ids_crc32``. ``model`` is the path of a file that
    every executor has, with identity normalisation and a blank put first. Rows are encoded whole and alone;
    nothing is shuffled. Words already met stay known to a Python worker up to a bound. A text's own U+2581 is
    decoded as a blank, as the format has it.

    Defined cases: null and empty texts have no ids and score 0; null ids stay null; equal texts get equal
    values; a word of any length is encoded whole, in memory and time that grow with its length; an empty
    table gives an empty table.
    """
    shown = zlib.crc32 if digest else bytes

    def encoder() -> Callable[[list[str | None]], list]:
        pieces = pieces_of(model)

        def encoded(texts: list[str | None]) -> list:
            rows = [(shown(ids), len(ids) // 4, float(score), good) for part in _together(texts) for ids, score, good in pieces.encode(texts[part])]
            return transposed(rows, 4)

        return encoded

    made = SCHEMA.replace("ids {0}", "ids_crc32 long" if digest else "ids binary")
    return beside(docs, [id_col], [text_col], made, encoder)
