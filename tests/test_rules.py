"""Rules over texts, links, headers and registered functions on small inputs."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import registered
from loamgrid.functions import text as X
from loamgrid.operators import context, fingerprints, graphs, links, lookups, records, tables
from loamgrid.sources import headers
from loamgrid.sources.files import bounds_of, interval, normalise_catalog


def each(spark, make, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r["o"] for r in df.select("k", make(F.col("v")).alias("o")).orderBy("k").collect()]


def test_asides_are_blanked_in_place(spark):
    given = ["It is 5 m. It would be 9 m; however the map says 5.", "For reference, 7!\nDone 3", "Might it, But no", "no asides but one", None, "a\x01b would\x01 c", "wouldn't it? could be", "butter would melt"]
    got = each(spark, context.strip_asides, given)
    assert got[0] == "It is 5 m. " + " " * len("It would be 9 m") + "; however the map says 5."
    assert got[1].split("\n")[0].strip() == "" and got[1].endswith("\nDone 3")
    assert got[2] == " " * len("Might it") + ", But no" and got[3] == given[3] and got[4] is None
    assert got[5].strip() == "" and len(got[5]) == len(given[5])
    assert got[6].endswith(" " * len("could be")) and got[7].strip() == ""
    assert all(g is None or len(g) == len(v) for g, v in zip(got, given, strict=True))


def test_names_stems_and_tags(spark):
    assert each(spark, X.author_key, ["and Shaowen  Wang", "& Wang, S.", "  ANDREA  Müller-Lüdenscheidt ", "and", None, "O'Neil_2 (ed.)"]) == ["shaowen wang", "wang s.", "andrea müller-lüdenscheidt", "and", "", "oneil_2 ed."]
    assert each(spark, X.stem_long, ["mapping", "mapped", "cities", "basins", "is", "payment"]) == ["map", "map", "cit", "basin", "is", "pay"]
    assert each(spark, X.sanitize_tag, ["a b+c-d=e._:/", "é#\n*", "x" * 200]) == ["a b+c-d=e._:/", "____", "x" * 128]


def test_author_links(spark):
    specs = spark.createDataFrame([(1, "and Ann Bee"), (1, "C. Dee"), (2, "ann bee"), (3, "No One"), (4, "C. DEE"), (5, "Ann Bee")], "spec long, author string")
    elements = spark.createDataFrame([(10, "ANN  BEE"), (11, "Ann Bee,"), (12, "c. dee"), (13, "")], "element long, author string")
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4), (1, 12, 0.1), (2, 10, 0.5), (2, 11, 0.41), (4, 12, 0.04), (5, 11, 0.3), (5, 10, 0.3)], "spec long, element long, score double")
    got = {r["spec"]: r for r in links.shared_author_links(specs, elements, scores, "spec", "element").collect()}
    assert set(got) == {1} and got[1]["element"] == 10 and got[1]["runner_up"] == 0.4 and got[1]["candidates"] == 3 and got[1]["authors"] == ["ann bee"]


def test_sources_behind_answers(spark):
    used = spark.createDataFrame([("a", 5), ("a", 9), ("b", 2), ("c", 77)], "answer string, call long")
    derived = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (9, 1)], "src long, dst long")  # a cycle is no harm
    sources = spark.createDataFrame([(3, "x", True), (4, "y", True), (1, "z", False), (2, "y", True), (2, "y", True)], "call long, source string, ok boolean")
    got = links.sources_used(used, derived, sources, "answer", "call", "source", ~F.col("ok")).collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("a", "y"), ("b", "y")]


def _sources_by_search(used, derived, sources):
    found = set()
    for answer, call in used:
        seen, todo = {call}, [call]
        while todo:
            at = todo.pop()
            found |= {(answer, s) for c, s in sources if c == at}
            more = {d for s, d in derived if s == at} - seen
            seen |= more
            todo += more
    return found


@pytest.mark.parametrize("fan", [1, 2])
def test_sources_behind_answers_as_a_plain_search_finds_them(spark, fan):
    rnd = random.Random(fan)
    for _ in range(3):
        derived = [(k, rnd.randrange(40)) for k in range(40) for _ in range(fan) if rnd.random() < 0.8]  # cycles and loops are among them
        sources = [(rnd.randrange(45), rnd.choice([None, *range(150)])) for _ in range(200)]
        used = [(rnd.choice([None, *range(8)]), rnd.randrange(45)) for _ in range(12)]
        frames = spark.createDataFrame(used, "answer long, call long"), spark.createDataFrame(derived, "src long, dst long"), spark.createDataFrame(sources, "call long, source long")
        got = [tuple(r) for r in links.sources_used(*frames, "answer", "call", "source").collect()]
        assert len(got) == len(set(got)) and set(got) == _sources_by_search(used, derived, sources)


def test_values_share_no_bit(spark):
    places, few = links.places_in_words(spark.range(500).selectExpr("cast(id % 400 as string) as v"), "v", 90)
    rows = places.collect()
    assert few and len(rows) == len({r["v"] for r in rows}) == len({(r["word"], r["bit"]) for r in rows}) == 400
    assert all(bin(r["bit"] & (2**64 - 1)).count("1") == 1 for r in rows) and len({r["word"] for r in rows}) <= 15


def test_sources_of_a_long_chain_make_no_pairs_of_calls(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(graphs, "durable", lambda df: stored.append(df.localCheckpoint()) or stored[-1])
    calls = spark.range(60).select(F.col("id").alias("call"))
    derived = calls.select(F.col("call").alias("src"), (F.col("call") - 1).alias("dst"))
    got = links.sources_used(calls.select(F.col("call").alias("answer"), "call"), derived, calls.select("call", (F.col("call") % 3).alias("source")), "answer", "call", "source").collect()
    assert len(got) == 1 + 2 + 58 * 3
    assert len(stored) < 20 and max(df.count() for df in stored) <= 60


def test_kinds_buckets_and_causes(spark):
    assert each(spark, lambda v: lookups.page_kind(v, lookups.SERVED_INSTEAD), ["Checking your BROWSER", "x" * 4001 + "we use cookies", "we use cookies", "fine"]) == ["a bot-check page", "document", "a cookie consent page", "document"]
    df = spark.createDataFrame([(None, 5), ("", 0), ("a note", 3), ("a note", 0), ("No TEXT layer", 9), ("could not be opened", 0), ("bot-check and zip archive", 0)], "r string, n int")
    assert [r[0] for r in df.select(lookups.reach_bucket(F.col("r"), F.col("n"))).collect()] == ["readable", "wrong type", "readable", "wrong type", "no text", "broken", "wall"]
    df = spark.createDataFrame([("gate:projected_crs", "g.area > 0"), ("gate:projected_crs", None), ("gate:new", "x"), ("peer", "x"), ("audit", None)], "c string, m string")
    assert [r[0] for r in df.select(lookups.finding_cause(F.col("c"), F.col("m"))).collect()] == ["a test for non-zero size", "a metric operation on a geographic CRS", "another gate", "unattributed", "a claim outside the record"]


def test_a_category_without_rows_is_an_error(spark):
    df = spark.createDataFrame([("Theft",), ("ASSAULT",), (None,)], "kind string")
    assert lookups.category_filter(df, "kind", " violent ", {"Violent": ["assault", "homicide"]}).count() == 1
    assert lookups.category_filter(df, "kind", "theft", {}).count() == 1
    with pytest.raises(lookups.NoSuchCategory, match="ASSAULT"):
        lookups.category_filter(df, "kind", "arson", {})


def test_tools_and_citations(spark):
    assert each(spark, lookups.tool_names, ["Two-Step Area (E2SFCA) method", "osm.Network(x)", "data", None])[:1] == [["two-step area", "e2sfca", "two-step_area_(e2sfca)_method"]]
    specs = spark.createDataFrame([(1, ["Floating (e2sfca)", "map"])], "spec long, tools array<string>")
    units = spark.createDataFrame([(7, "E2SFCA", None, None), (8, "e2sfca", True, None), (9, "e2sfca", None, True), (10, "map", None, None)], "unit long, symbol string, amb boolean, ali boolean")
    assert [tuple(r) for r in lookups.spec_unit_links(specs, units, "spec", "tools", "unit", "symbol", F.col("amb"), F.col("ali")).collect()] == [(1, 7, "e2sfca", "low")]


def test_first_value_of_a_parameter(spark):
    parts = spark.createDataFrame([(1, 2, {"a": "late", "c": "3"}), (1, 1, {"a": "first", "b": "2"}), (2, 1, {})], "doc long, n long, p map<string,string>")
    assert {r["doc"]: r["p"] for r in records.merge_params(parts, "doc", "n", "p").collect()} == {1: {"a": "first", "b": "2", "c": "3"}}


def test_selection_by_column(spark):
    df = spark.createDataFrame([("9", "x"), ("10", "y"), ("n/a", "z"), (None, None)], "mixed string, words string")
    got = lambda c, op, v: [r[c] for r in tables.select(df, c, op, v).orderBy(c).collect()]
    assert got("mixed", ">", 9) == ["10"] and got("mixed", "!=", 9) == [None, "10", "n/a"]
    assert got("words", ">", 9) == ["x", "y", "z"] and got("words", "==", "y") == ["y"]


def test_digest_of_a_corpus(spark):
    rows = [(k, f"text {k % 7}", None if k % 5 else "en") for k in range(300)]
    make = lambda r, **how: fingerprints.corpus_fingerprint(spark.createDataFrame(r, "id long, t string, l string"), "id", ["t", "l"], **how).first()
    one = make(rows)
    assert one["n"] == 300 and make(rows[::-1])["digest"] == one["digest"] and len(one["digest"]) == 64
    spread = spark.createDataFrame(rows, "id long, t string, l string").repartition(7)
    assert fingerprints.corpus_fingerprint(spread, "id", ["t", "l"]).first()["digest"] == one["digest"]
    changed = [rows[:-1], [*rows, rows[0]], [(0, "text 1", "en"), *rows[1:]], [(0, "text 0", None), *rows[1:]], [(1000, *rows[0][1:]), *rows[1:]]]
    assert len({one["digest"], *(make(r)["digest"] for r in changed)}) == 6
    assert make([])["n"] == 0


def test_headers():
    las = bytearray(375)
    las[:4], las[25] = b"LASF", 4
    struct.pack_into("<4d", las, 179, 4.0, 1.0, 5.0, 2.0)
    struct.pack_into("<Q", las, 247, 2**33)
    assert headers.header_of("a.las", bytes(las))[:6] == ("las", 2**33, 1.0, 2.0, 4.0, 5.0)
    big = b"II+\0" + struct.pack("<HHQ", 8, 0, 16) + struct.pack("<Q", 2) + struct.pack("<HHQQ", 256, 4, 1, 640) + struct.pack("<HHQQ", 257, 4, 1, 480)
    assert headers.header_of("a.tif", big) == ("tiff", None, None, None, None, None, 640, 480, None)
    assert headers.header_of("a.tif", b"MM\0*" + struct.pack(">I", 9999)) == ("tiff", *headers.NOTHING[1:])
    assert headers.header_of("a.las", b"LASF") == headers.NOTHING == headers.header_of("x.bin", b"\1\2") == headers.header_of(None, None)
    assert headers.header_of("t.CSV", b"a,b\r\n1,2\n") == ("csv", 2, None, None, None, None, None, None, ["a", "b"])
    assert headers.header_of("t.dbf", b"\x03" + bytes(3)) == headers.NOTHING


def test_functions_by_name(spark):
    assert {"haversine_m", "file_header", "osm_feature", "weighted_median"} <= set(registered.register(spark))
    row = spark.sql("SELECT haversine_m(0D, 0D, 1D, 0D) AS m, in_box(1D, 1D, 1D, 1D, 2D, 2D) AS b, as_number(' 1,234.5 ') AS n").first()
    assert abs(row["m"] - 111195.08) < 0.1 and row["b"] and row["n"] == 1234.5
    got = spark.sql("SELECT f.* FROM VALUES ('{\"type\":\"way\",\"id\":1,\"geometry\":[{\"lon\":1,\"lat\":2}]}'), ('not json'), (NULL), ('{\"type\":\"node\",\"id\":2,\"lon\":3,\"lat\":4}') AS t(e), LATERAL osm_feature(t.e) AS f").collect()
    assert [tuple(r)[:3] for r in got] == [("node/2", "Point", 1)]
    median = spark.sql("SELECT g, weighted_median(v, w) AS m FROM VALUES ('a', 1D, 1D), ('a', 5D, 3D), ('a', 9D, 1D), ('b', NULL, 1D) AS t(g, v, w) GROUP BY g").collect()
    assert {r["g"]: r["m"] for r in median}["a"] == 5.0


def test_catalogue_parts(spark):
    assert each(spark, bounds_of, ['{"coordinates":[[[1,2],[3.5,-4],[-1e1,0]]]}', "{}", None]) == [[-10.0, -4.0, 3.5, 2.0], None, None]
    assert each(spark, lambda v: F.array(*interval(v)), ["2001/2002", "/2002", "2003", None]) == [["2001", "2002"], [None, "2002"], ["2003", "2003"], [None, None]]
    landed = spark.createDataFrame([("datacite", '{"id":"10.1/x","attributes":{"titles":[{"title":" T "}],"publicationYear":1999}}'), ("nowhere", "{}"), ("socrata", "not json")], "provider string, payload string")
    got = {r["source"]: r for r in normalise_catalog(landed).collect()}
    assert set(got) == {"datacite", "socrata"} and (got["datacite"]["id"], got["datacite"]["title"], got["datacite"]["start"], got["datacite"]["bbox"]) == ("10.1/x", "T", "1999-01-01", None)
