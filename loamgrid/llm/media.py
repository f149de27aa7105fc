"""Texts as lossless images and back, on Spark."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from loamgrid.llm.batches import beside, transposed
from loamgrid.llm.webp import decode, decode_payload, encode_payload

STORED_SCHEMA = "n_bytes long, media binary"
PIXEL_SCHEMA = "height int, width int, pixels binary, problem string"


def padded(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, payload): bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the WebP file of each whole text. Null counts as empty; equal texts get equal files."""

    def stored(texts: list[str | None]) -> list[list]:
        return transposed([(n, encode_payload(payload)) for n, payload in map(padded, texts)], 2)

    return beside(docs, [id_col], [text_col], STORED_SCHEMA, lambda: stored)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, height, width, the pixels (little-endian ARGB bytes) and ``problem`` of any lossless WebP files.

    Null files give null in all; a file that isn't whole or isn't of this format gives null pixels and says why.
    """

    def pixels(files: list[bytes | None]) -> list[list]:
        return transposed([pixels_of(m) for m in files], 4)

    return beside(media, [id_col], [media_col], PIXEL_SCHEMA, lambda: pixels)


def pixels_of(media: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    """(height, width, pixels, problem) of one file."""
    if media is None:
        return None, None, None, None
    try:
        argb = decode(bytes(media))
    except (ValueError, IndexError, KeyError, OverflowError, MemoryError) as e:  # what a damaged file leads to
        return None, None, None, f"{type(e).__name__}: {e}"
    return *argb.shape, argb.astype("<u4").tobytes(), None


def feature_of(argb: np.ndarray) -> str:
    """Shape, mean green, entropy of green, and a 64-bit mean hash over an 8 x 8 grid of the pixels."""
    green = ((argb >> 8) & 0xFF).astype(np.uint8)
    p = np.bincount(green.reshape(-1), minlength=256) / green.size
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0
    sums = np.add.reduceat(green.reshape(-1).astype(np.int64), np.arange(64) * green.size // 64)
    sizes = np.diff(np.r_[np.arange(64) * green.size // 64, green.size])
    marks = np.packbits(sums * green.size > green.sum(dtype=np.int64) * sizes).tobytes().hex()
    return f"{green.shape[0]}x{green.shape[1]};{green.mean():.3f};{entropy:.3f};{marks}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored, read back from the stored bytes, and described.

    id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (both of what was read back), media_bytes,
    media_sha256, feature. Each row stands alone, so nothing is shuffled and a lost task is done again.

    Defined cases: null and empty texts are 64 bytes 0; equal texts get equal values; null ids stay null;
    an empty table gives an empty table. Texts over 256 MiB raise an error.
    """
    stored = store_texts(docs, id_col, text_col)

    def digests(files: list[bytes]) -> list[list]:
        rows = []
        for media in files:
            payload, argb = decode_payload(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(argb)))
        return transposed(rows, 6)

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return beside(stored, [id_col, "n_bytes"], ["media"], made, lambda: digests)
