import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.llm import webp as W
from loamgrid.llm.media import decode_media, media_digests, padded, store_texts

RNG = np.random.default_rng(7)
IMAGES = {
    "noise": RNG.integers(0, 2**32, (13, 17), dtype=np.uint64).astype(np.uint32),
    "slope": W._argb(np.stack([np.add.outer(np.arange(40), np.arange(37) * (k + 1)) % 256 for k in range(4)], -1).astype(np.uint8)),
    "few": RNG.choice(np.array([5, 0xFF00FF00, 0x12345678, 0xFFFFFFFF], np.uint32), (20, 23)),
    "dot": np.array([[0x80FF0102]], np.uint32),
}


def tiles(image, most):
    h, w = image.shape
    return RNG.integers(0, most, ((h + 3) // 4, (w + 3) // 4)).astype(np.uint32)


@pytest.mark.parametrize("name", IMAGES)
@pytest.mark.parametrize("how", ["plain", "cache", "groups", "green", "predictor", "cross", "all"])
def test_round_trips(name, how):
    image = IMAGES[name]
    modes, elements = tiles(image, 14) << np.uint32(8), tiles(image, 2**24)
    steps = {"green": (("green",),), "predictor": (("predictor", modes, 2),), "cross": (("cross", elements, 2),), "all": (("predictor", modes, 2), ("cross", elements, 2), ("green",))}.get(how, ())
    data = W.encode(image, steps, cache_bits=4 if how in ("cache", "all") else 0, tile_bits=2 if how in ("groups", "all") else 0)
    assert (W.decode(data) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    image = RNG.choice(np.arange(colours, dtype=np.uint32) * 65793 + 1, (9, 21))
    assert (W.decode(W.encode(image, (("palette",),))) == image).all()


def test_every_predictor_by_a_slow_rule():
    """Each mode against one pixel at a time, by the format's own words."""
    image = IMAGES["slope"][:9, :8]
    x = W._channels(image).astype(int)
    for mode in range(14):
        residual = W._channels(W.do_predictor(image, np.full((3, 2), mode << 8, np.uint32), 2)).astype(int)
        for r in range(1, 9):
            for c in range(1, 8):
                left, top, corner = x[r, c - 1], x[r - 1, c], x[r - 1, c - 1]
                right = x[r - 1, c + 1] if c < 7 else x[r, 0]
                av = lambda a, b: (a + b) // 2
                sel = left if abs(top - corner).sum() < abs(left - corner).sum() else top
                half = [min(255, max(0, a + int((a - b) / 2))) for a, b in zip(av(left, top), corner, strict=True)]
                guess = [np.array([0, 0, 0, 255]), left, top, right, corner, av(av(left, right), top), av(left, corner), av(left, top), av(corner, top), av(top, right), av(av(left, corner), av(top, right)), sel, np.clip(left + top - corner, 0, 255), np.array(half)][mode]
                assert (residual[r, c] == (x[r, c] - guess) % 256).all(), mode


def test_a_file_made_elsewhere():
    assert W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


@pytest.mark.parametrize("data", [b"", b"RIFF", W.encode(IMAGES["few"])[:40], b"x" * 60])
def test_broken_files(data):
    with pytest.raises(W.WebPError):
        W.decode(data)


@given(st.binary(max_size=700).map(lambda b: b.replace(b"\xff", b"a")))
@settings(max_examples=80, deadline=None)
def test_payloads(raw):
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert W.decode_payload(W.encode_payload(payload))[0] == payload


def test_long_payload_gets_wider_rows():
    payload = bytes(range(255)) * 4200
    payload += b"\0" * (-len(payload) % 64)
    got, argb = W.decode_payload(W.encode_payload(payload))
    assert got == payload and argb.shape[1] == 128


def test_on_spark(odd_docs, docs_of):
    want = []
    for r in odd_docs.collect():
        n, payload = padded(r["text"])
        want.append((str(r["doc_id"]), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = media_digests(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    stored = store_texts(odd_docs.where("doc_id = 7")).first()
    pixels = decode_media(store_texts(odd_docs.where("doc_id = 7"))).first()
    assert (W.decode(bytes(stored["media"])).astype("<u4").tobytes()) == bytes(pixels["pixels"])
    assert media_digests(docs_of([])).count() == 0
