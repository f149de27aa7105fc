"""Several tables under one version: replacing and removing as units, merges, conflicts, and what a failure leaves."""

import os

import pytest
from pyspark.sql import functions as F

from loamgrid.plans import records
from loamgrid.sources.store import GONE, MARK, RecordStore, VersionConflict, changed, fingerprints

A, B = "doc long, v string", "doc long, n long"


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"), "doc", most_layers=4)


def tables(spark, a, b):
    return {"a": spark.createDataFrame(a, A), "b": spark.createDataFrame(b, B)}


def put(store, t):
    return store.replace(t, changed(store, fingerprints(t, "doc")))


def state(store, version=None):
    return {t: sorted(tuple(r) for r in store.read(t, version).collect()) for t in ("a", "b")}


def folders(store):
    return sum(len(os.listdir(f"{store.folder}/tables/{t}")) for t in os.listdir(f"{store.folder}/tables"))


def test_parents_are_replaced_and_removed_in_all_tables(spark, store):
    put(store, tables(spark, [(1, "x"), (1, "y"), (2, "z"), (None, "nobody")], [(1, 10), (3, 30)]))
    first = {"a": [(1, "x"), (1, "y"), (2, "z")], "b": [(1, 10), (3, 30)]}
    assert state(store) == first
    put(store, tables(spark, [(1, "new")], [(2, 20)]))  # 1 loses its row in b, 2 its row in a
    assert state(store) == {"a": [(1, "new")], "b": [(2, 20), (3, 30)]}
    store.remove(spark.createDataFrame([(3,), (99,)], "doc long"))
    assert state(store) == {"a": [(1, "new")], "b": [(2, 20)]} and state(store, 1) == first
    put(store, tables(spark, [(3, "back")], []))
    assert state(store) == {"a": [(1, "new"), (3, "back")], "b": [(2, 20)]}
    store.remove_orphans(spark.createDataFrame([(2,)], "doc long"))
    assert state(store) == {"a": [], "b": [(2, 20)]}


def test_unchanged_input_adds_nothing(spark, store):
    t = tables(spark, [(1, "x"), (2, "z")], [(1, 10)])
    put(store, t)
    n = folders(store)
    for k in range(3):
        put(store, {k: v.repartition(3) for k, v in t.items()})
        assert store.replace(t, changed(store, fingerprints(t, "doc")), ("s", k))["version"] == 2 + k  # a batch is noted
    assert folders(store) == n and len(store.manifest()["layers"]) == 1
    assert store.remove(spark.createDataFrame([(77,)], "doc long"))["version"] == 4


def test_a_batch_done_twice_counts_once(spark, store):
    t = tables(spark, [(1, "x")], [])
    for _ in range(2):
        store.replace(t, changed(store, fingerprints(t, "doc")), ("s", 0))
    store.replace(tables(spark, [(1, "late")], []), fingerprints(tables(spark, [(1, "late")], []), "doc"), ("s", 0))
    assert state(store)["a"] == [(1, "x")] and store.versions() == [1]


def test_layers_merge_and_old_ones_go(spark, store):
    for k in range(6):
        put(store, tables(spark, [(j, f"{k}") for j in range(k, 8)], [(k, k)]))
    want = state(store)
    assert len(store.manifest()["layers"]) <= 4
    store.compact()
    assert state(store) == want and len(store.manifest()["layers"]) == 1
    store.vacuum(keep=1)
    assert folders(store) == 3 and state(store) == want and len(store.versions()) == 1
    assert {tuple(r) for r in store.counts().collect()} == {("a", len(want["a"]), len({r[0] for r in want["a"]})), ("b", len(want["b"]), len({r[0] for r in want["b"]}))}


def test_a_writer_that_dies_loses_nothing(spark, store, monkeypatch):
    put(store, tables(spark, [(1, "x"), (2, "y")], [(1, 10)]))
    put(store, tables(spark, [(1, "z")], [(1, 10)]))
    want = state(store)
    for act in (store.compact, lambda: put(store, tables(spark, [(2, "never")], []))):
        monkeypatch.setattr(RecordStore, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            act()
        monkeypatch.undo()
        assert state(store) == want
    store.compact()
    assert state(store) == want
    store.vacuum(keep=1)
    assert state(store) == want and folders(store) == 3


def test_the_second_of_two_writers_is_told(spark, store):
    put(store, tables(spark, [(1, "x")], []))
    stale = store.manifest()
    put(store, tables(spark, [(2, "y")], []))
    marks = spark.createDataFrame([(3, "f", False)], f"doc long, {MARK} string, {GONE} boolean")
    layer = store._write_layer(stale["version"] + 1, tables(spark, [(3, "z")], []), marks)
    with pytest.raises(VersionConflict):
        store._publish({**stale, "version": stale["version"] + 1, "layers": [*stale["layers"], layer]})
    assert state(store)["a"] == [(1, "x"), (2, "y")]


def test_columns_that_come_later(spark, store):
    put(store, tables(spark, [(1, "x")], []))
    more = {"a": spark.createDataFrame([(2, "y", 2**60 + 1)], "doc long, v string, extra long")}
    put(store, more)
    assert sorted(map(tuple, store.read("a").collect())) == [(1, "x", None), (2, "y", 2**60 + 1)]
    assert store.read("a", 1).columns == ["doc", "v"]
    with pytest.raises(KeyError):
        store.read("c")
    assert fingerprints({"a": store.read("a").where(F.lit(False))}, "doc").count() == 0


def test_fingerprints_are_found_once(spark, store):
    t = tables(spark, [(k, f"{k}") for k in range(20)], [(k, k) for k in range(20)])
    looked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: looked.add(1) or True, "boolean")
    store.replace(t, fingerprints(t, "doc").where(seen("doc")))
    assert 20 <= looked.value <= 40  # a checkpoint may go over its rows twice; a look for each table would be over that
    assert store.marks().count() == 20 and len(state(store)["a"]) == 20


def test_fingerprints_of_tables_and_of_their_parts_are_the_same(spark):
    a, b = [(1, "x"), (1, "x"), (1, None), (2, "y"), (None, "z")], [(2, 1), (3, 2)]
    prints = lambda n: {r["doc"]: r[MARK] for r in fingerprints({k: v.repartition(n, F.rand(1)) for k, v in tables(spark, a, b).items()}, "doc").collect()}
    assert prints(1) == prints(5) and set(prints(1)) == {1, 2, 3}
    assert prints(1)[1].startswith("3:") and prints(1)[2].startswith("2:")


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_few_replaced_parents_move_no_rows(spark, tmp_path, few):
    store = RecordStore(spark, str(tmp_path / "store"), "doc", few=few)
    put(store, tables(spark, [(k, "old") for k in range(30)], [(k, k) for k in range(30)]))
    put(store, tables(spark, [(k, "new") for k in range(0, 30, 10)], []))
    put(store, tables(spark, [(0, "newest")], []))
    store.remove(spark.createDataFrame([(7,)], "doc long"))
    want = [(k, "newest" if k == 0 else "new" if k % 10 == 0 else "old") for k in range(30) if k != 7]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = store.read("a")
        assert sorted(map(tuple, rows.collect())) == want
        assert ("Exchange hashpartitioning" in rows._jdf.queryExecution().executedPlan().toString()) == (few == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    store.compact()
    assert state(store)["a"] == want


def test_orders_and_lines_of_the_record_tables_meet_once(spark, sf_dir):
    customers, stored = records.read(spark, sf_dir, "customer"), records._dealt_records(spark, sf_dir)
    for first_year in (None, 1995):
        made = records._record_tables(customers, *stored, first_year)
        assert len(made) == 8 and all(t == "element" or rows.inputFiles() == [] for t, rows in made.items())


def test_replacing_all_is_replacing_by_fingerprints_and_moves_no_rows(spark, store, monkeypatch):
    put(store, tables(spark, [(1, "x"), (5, "stays")], [(1, 10)]))
    write, plans = RecordStore._write_layer, {}

    def spy(self, number, given, marks):
        plans.update({t: rows._jdf.queryExecution().executedPlan().toString() for t, rows in given.items()})
        return write(self, number, given, marks)

    monkeypatch.setattr(RecordStore, "_write_layer", spy)
    t = tables(spark, [(1, "new"), (2, "y"), (None, "nobody")], [(3, 30), (None, 1)])
    store.replace_all(t)
    assert state(store) == {"a": [(1, "new"), (2, "y"), (5, "stays")], "b": [(3, 30)]}
    assert len(plans) == 2 and not any("Join" in p or "Exchange" in p for p in plans.values())
    assert changed(store, fingerprints(t, "doc")).count() == 0
    assert store.replace_all(t, ("s", 1))["batches"] == {"s": 1} and store.replace_all(t, ("s", 1))["version"] == 3
