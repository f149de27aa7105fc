import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import warc

SCHEMA = "page_id long, url string, html string, member string, shard int"


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://x.example/{i}", f"<p>{'long text ' * (i % 9)}{i % 40}</p>", "m", 1) for i in range(200)]
    rows += [(i, None, "<p>copy</p>", "m", 1) for i in range(500, 620)]  # a hot payload
    rows += [(700, "http://a b\r\nWARC-Type: x", None, None, None), (701, "", "", None, None), (702, "u", "é" * 100_000, None, None), (2**60 + 1, "u", "big", None, None), (2**60 + 2, "u", "big", None, None)]
    rows += [(None, "n", "without an id", None, None), (None, "n", "<p>copy</p>", None, None), (800, "r", "repeated", None, None), (800, "r", "repeated", None, None), (None, "n", "twice", None, None), (None, "n", "twice", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def archived(spark, df, folder, **how):
    warc.write_archive(df, str(folder), **how)
    return warc.read_archive(spark, str(folder)).collect()


def files(folder):
    return {f: (folder / f).read_bytes() for f in os.listdir(folder) if f.endswith(".warc.gz")}


def test_round_trip_and_revisits(spark, pages, tmp_path):
    got = archived(spark, pages, tmp_path / "a", roll=2000)
    given = pages.collect()
    assert len(got) == len(given)
    texts = {}
    for r in given:
        texts.setdefault(r["page_id"], []).append((r["html"] or "").encode())
    first = {}
    for r in given:
        if r["page_id"] is not None:
            k = (r["html"] or "").encode()
            first[k] = min(first.get(k, r["page_id"]), r["page_id"])
    seen = set()
    for r in got:
        payload = r["payload"]
        if r["record_type"] == "response":
            assert bytes(payload) in texts[r["page_id"]] and r["refers_to"] is None and bytes(payload) not in seen
            seen.add(bytes(payload))
            assert first.get(bytes(payload), r["page_id"]) == r["page_id"]
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r["payload_bytes"] == len(payload)
        else:
            mine = [t for t in texts[r["page_id"]] if warc.sha1_base32(t) == r["payload_digest"]]
            assert payload is None and mine and r["payload_bytes"] == len(mine[0]) and r["refers_to"] == first.get(mine[0])
    assert seen == {t for ts in texts.values() for t in ts}
    assert sum(r["page_id"] == 800 and r["record_type"] == "response" for r in got) == 1
    assert len({r["record_id"] for r in got if r["page_id"] is not None}) == len([r for r in got if r["page_id"] is not None])


def test_same_bytes_however_dealt(spark, pages, tmp_path):
    for name, n in (("a", 1), ("b", 7)):
        warc.write_archive(pages.repartition(n), str(tmp_path / name), shards=5, roll=3000)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 5
    assert all(len(x) < 3000 + 2000 for x in a.values())
    ids = []
    for f in sorted(a):
        records = [warc.parsed(x)[0] for x in warc.members(iter([a[f]]))]
        assert records[0]["warc-type"] == "warcinfo" and records[0]["warc-filename"] == f
        ids += [int(r["x-page-id"]) for r in records if "x-page-id" in r]
        assert gzip.decompress(a[f]).startswith(b"WARC/1.1\r\n")
    assert ids == sorted(ids) and len(ids) > 300


def test_only_the_manifest_counts(spark, pages, tmp_path):
    folder = tmp_path / "a"
    manifest = warc.write_archive(pages, str(folder), shards=3)
    (folder / "shard-00000-00000.warc.gz.lost.tmp").write_bytes(b"half a file")
    assert {r["file"] for r in manifest.collect()} == set(files(folder))
    n = pages.count()
    assert warc.read_archive(spark, str(folder), payloads=False).count() == n
    # renaming again, as a task that is done twice does, changes nothing
    again = spark.read.parquet(str(folder / "staged")).mapInArrow(lambda it: warc._renamed(it, str(folder)), "file string, shard int, part int, records long, bytes long, sha256 string")
    assert again.count() == manifest.count() and warc.read_archive(spark, str(folder), payloads=False).count() == n


def test_damage_is_noticed(spark, pages, tmp_path):
    folder = tmp_path / "a"
    warc.write_archive(pages, str(folder), shards=2)
    f = sorted(files(folder))[0]
    data = bytearray((folder / f).read_bytes())
    data[len(data) // 2] ^= 1
    (folder / f).write_bytes(bytes(data))
    with pytest.raises(Exception):  # noqa: B017
        warc.read_archive(spark, str(folder)).count()


def test_least_bytes_and_empty(spark, pages, tmp_path):
    got = archived(spark, pages, tmp_path / "a", least_bytes=10)
    assert {r["record_type"] for r in got if r["payload_bytes"] < 10} == {"response"}
    assert any(r["record_type"] == "revisit" for r in got if r["payload_bytes"] >= 10)
    assert archived(spark, pages.where(F.lit(False)), tmp_path / "b") == []


def test_split_streams():
    data = [warc.gzip_member(bytes([k]) * k) for k in range(1, 9)]
    whole = b"".join(data)
    for step in (1, 3, 1000):
        assert list(warc.members(whole[k : k + step] for k in range(0, len(whole), step))) == [bytes([k]) * k for k in range(1, 9)]
    with pytest.raises(ValueError):
        list(warc.members(iter([whole[:-20]])))
