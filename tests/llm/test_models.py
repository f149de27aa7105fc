import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import int8_join as E
from loamgrid.llm import quality as Q
from loamgrid.llm import sharding as S
from loamgrid.llm import toxicity as T


def texts(n, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400)]
    return rng, [" ".join(rng.choices(vocab, k=rng.randint(20, 80))) for _ in range(n)]


def auc(score, truth):
    score, truth = np.asarray(score), np.asarray(truth, bool)
    rank = score.argsort().argsort() + 1
    return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


def test_toxicity_on_held_out_rows(spark, docs_of):
    rng, base = texts(900)
    rows, labels = [], []
    for k, t in enumerate(base):
        bad = rng.random() < 0.2
        rows.append((k, t + (" you zzfool" + rng.choice("abc") if bad else "")))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train_toxicity(docs, lab)
    got = {r["doc_id"]: r["toxicity"] for r in T.score_toxicity(docs, model).collect()}
    truth = {k: "zzfool" in t for k, t in rows}
    held = [k for k in truth if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    assert auc([got[k] for k in held], [truth[k] for k in held]) > 0.99
    assert np.mean([(got[k] >= 0.5) == truth[k] for k in held]) > 0.95


def test_toxicity_without_labels(spark, odd_docs, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.train_toxicity(odd_docs, none)
    rows = T.score_toxicity(odd_docs.withColumn("toxicity", F.lit("old")), model).collect()
    assert len(rows) == 9 and all(r["toxicity"] < 0.01 for r in rows)
    assert T.score_toxicity(docs_of([]), model).count() == 0


def test_the_risk_can_t_go_below_zero():
    """With the clamp, texts that only repeat the positives are not all driven to one side."""
    rng = np.random.default_rng(3)
    pos = [np.sort(rng.choice(50, 5, replace=False)) for _ in range(60)]
    unl = [np.sort(50 + rng.choice(500, 8, replace=False)) for _ in range(300)] + [np.sort(rng.choice(50, 5, replace=False)) for _ in range(30)]
    model = T.fit_nnpu(pos, unl, 0.09, np.arange(550))
    assert np.isfinite(model.bias) and all(np.isfinite(w) for w in model.weights.values()) and model.bias < 0


def test_risk_and_step_against_a_plain_version():
    rng = np.random.default_rng(6)
    pos, unl = ((rng.random((n, 7)) < 0.4).astype(float) for n in (11, 23))
    sparse = lambda x: (np.nonzero(x)[1], np.nonzero(x)[0], len(x))

    def parts(w, prior):
        loss = lambda g, y: np.log1p(np.exp(-y * g)).mean()
        gp, gu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
        return prior * loss(gp, 1), loss(gu, -1) - prior * loss(gp, -1)

    signs = set()
    for prior in (0.2, 0.9):
        for _ in range(20):
            w = rng.normal(size=8) * 2
            a, b = parts(w, prior)
            got_a, got_b, step = T.risk_and_step(w, sparse(pos), sparse(unl), prior)
            assert np.allclose((got_a, got_b), (a, b))
            followed = (lambda x, b=b, prior=prior: sum(parts(x, prior)) if b >= 0 else -parts(x, prior)[1])  # noqa: B023
            plain = [(followed(w + h) - followed(w - h)) / 2e-6 for h in np.eye(8) * 1e-6]
            assert np.allclose(step, plain, atol=1e-6)
            signs.add(b >= 0)
    assert signs == {True, False}


def test_the_prior_is_that_of_the_texts_at_hand(spark, docs_of):
    """Labelled texts that an earlier step took away count for nothing, and an id labelled twice counts once."""
    rows = [(k, f"plain text {k % 9}" + (" zzfoolish" if k % 10 == 0 else "")) for k in range(800)]
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(800)] + [(k, 1, 0) for k in range(0, 800, 10)] + [(5000 + k, 0, 0) for k in range(3000)], "doc_id long, quality int, toxic int")
    model = T.train_toxicity(docs_of(rows), labels)
    train = [k for k in range(800) if __import__("zlib").crc32(str(k).encode()) % 5]
    assert model.prior == sum(k % 10 == 0 for k in train) / len(train)
    got = {r["doc_id"]: r["toxicity"] >= 0.5 for r in T.score_toxicity(docs_of(rows), model).collect()}
    assert all(got[k] == (k % 10 == 0) for k in got)


def test_quality_on_held_out_rows(spark, docs_of):
    rng, base = texts(600, 5)
    rows, labels = [], []
    for k, t in enumerate(base):
        bad = rng.random() < 0.25
        rows.append((k, " ".join(w + "$$$" for w in t.split()) if bad else t))
        if k % 2 == 0:
            labels.append((k, int(not bad), 0))
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["quality_score"] for r in Q.score_quality(docs, lab).collect()}
    assert np.mean([(got[k] >= 0.5) == ("$$$" not in t) for k, t in rows]) > 0.98


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9)] * 400 + [("low", "p", 0.1)] * 400 + [("tiny", "p", 0.1)]
    post = {r["host"]: r for r in Q.site_posteriors(spark.createDataFrame(rows, "h string, p string, evidence double"), "h", "p").collect()}
    assert abs(post["big"]["host_posterior"] - 0.9) < 0.05 and post["tiny"]["host_posterior"] > post["low"]["host_posterior"]


def test_quality_of_odd_rows(spark, odd_docs, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = odd_docs.withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))).withColumn("evidence", F.lit("old"))
    rows = Q.score_quality(odd, none).collect()
    assert len(rows) == 9 and all(r["evidence"] == 0.5 for r in rows)
    assert Q.score_quality(docs_of([]), none).count() == 0


def test_quality_with_any_column_names(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    more = {c: F.lit(f"my {c}") for c in ("host", "path", "corpus_mean", "h", "n", "c0", "c1", "id", "out")}
    docs = docs_of([(1, "some words"), (2, None)]).withColumns(more)
    rows = Q.score_quality(docs, none).collect()
    assert len(rows) == 2 and all(r[c] == f"my {c}" for r in rows for c in more)
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "some words", 2: None}


def test_posteriors_by_hand(spark):
    """The shrinkage of sites against the same rule written out with plain numbers."""
    rng = random.Random(4)
    rows = [(h, p, min(1.0, max(0.0, rng.gauss({"a": 0.8, "b": 0.4, "c": 0.6}[h] + 0.05 * k, 0.1)))) for h in "abc" for k, p in enumerate("xyz") for _ in range(rng.randint(2, 40))]

    def kappa(groups):
        n, g = sum(map(len, groups)), len(groups)
        mean = sum(map(sum, groups)) / n
        inside = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in groups) / (n - g)
        size = (n - sum(len(v) ** 2 for v in groups) / n) / (g - 1)
        between = (sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in groups) / (g - 1) - inside) / size
        return mean, min(max(inside / between, 1.0), 1e6) if between > 0 else 1e6

    hosts = {h: [e for a, _, e in rows if a == h] for h in "abc"}
    cells = {(h, p): [e for a, b, e in rows if (a, b) == (h, p)] for h in "abc" for p in "xyz"}
    (mean, by_host), (_, by_path) = kappa(list(hosts.values())), kappa(list(cells.values()))
    got = {(r["host"], r["path"]): r for r in Q.site_posteriors(spark.createDataFrame(rows, "h string, p string, evidence double"), "h", "p").collect()}
    for (h, p), v in cells.items():
        host = (by_host * mean + sum(hosts[h])) / (by_host + len(hosts[h]))
        assert np.isclose(got[h, p]["host_posterior"], host) and np.isclose(got[h, p]["path_posterior"], (by_path * host + sum(v)) / (by_path + len(v)))


def plain_links(vectors, threshold):
    out = {}
    for i, v in vectors:
        out[i] = [j for j, w in vectors if j != i and ok(v) and ok(w) and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold]
    return out


def ok(v):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    vectors = [(k, (centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.45])).astype(np.float32).tolist()) for k in range(260)]
    vectors += [(300 + k, vectors[5][1]) for k in range(20)] + [(400, [0.0] * 16), (401, None), (402, [float("nan")] * 16), (403, [float("inf")] + [1.0] * 15), (404, [1.0, 2.0]), (405, [None] + [1.0] * 15), (406, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = plain_links([(i, None if v is None else [np.nan if e is None else np.float64(e) for e in v]) for i, v in vectors], 0.9)
    for block in (37, 2048):
        rows = {r["vec_id"]: r for r in E.embedding_links(df, block=block).collect()}
        assert {i: r["n_links"] for i, r in rows.items()} == {i: len(x) for i, x in want.items()}
        for i, linked in want.items():
            assert all(rows[j]["component_id"] == rows[i]["component_id"] for j in linked)
            assert rows[i]["component_id"] <= i and rows[rows[i]["component_id"]]["kept"]
        assert len({r["component_id"] for r in rows.values()}) == sum(r["kept"] for r in rows.values())
    assert E.embedding_links(df.limit(0)).count() == 0


def test_a_repeated_id_has_a_row_for_each_of_its_vectors(spark):
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [1.0, 0.1]), (4, [0.02, 1.0]), (9, [-1.0, -1.0])]
    for kind in ("float", "double"):
        rows = E.embedding_links(spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows) == [
            (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (9, 0, 9, True),
        ]


def test_the_error_bound_holds():
    rng = np.random.default_rng(4)
    u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(300, 64)), rng.normal(size=(300, 64))))
    (cu, su, eu), (cv, sv, ev) = E.quantised(u), E.quantised(v)
    exact, rough = u @ v.T, (cu.astype(float) * su[:, None]) @ (cv.astype(float) * sv[:, None]).T
    assert (np.abs(exact - rough) <= eu[:, None] * (1 + ev)[None, :] + ev[None, :] + 1e-12).all()


def test_shards(docs_of, tmp_path, spark):
    rng, base = texts(700, 8)
    docs = docs_of([(k, t * (k % 7)) for k, t in enumerate(base)])
    rows = S.shard_documents(docs, 5, 64, map_path=str(tmp_path / "map")).collect()
    load = {}
    for r in rows:
        load.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in rs) for rs in load.values()]
    assert max(sizes) < 1.1 * min(sizes)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in load.values())
    first = S.read_map(spark, str(tmp_path / "map"), 1)
    assert len(first) == 64
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_map(spark, first, str(tmp_path / "map"))
    one = S.read_map(spark, str(tmp_path / "map"))
    usage = {s: (n, b) for _, s, _, n, b in one}
    two = S.rebalanced(one, usage, 6)
    S.write_map(spark, two, str(tmp_path / "map"))
    assert {r[0] for r in S.read_map(spark, str(tmp_path / "map"))} == {one[0][0] + 1} and {r[0] for r in S.read_map(spark, str(tmp_path / "map"), 1)} == {1}
    again = S.shard_documents(docs, 6, 64, map_path=str(tmp_path / "map")).collect()
    assert {r["shard"] for r in again} == set(range(6))
    new = {}
    for _, slot, shard, _, size in two:
        new[shard] = new.get(shard, 0) + size
    assert len(new) == 6 and max(new.values()) < 1.25 * min(new.values())
    moved = [slot for (_, slot, a, _, _), (_, _, b, _, _) in zip(sorted(one, key=lambda r: r[1]), two, strict=True) if a != b]
    assert len(moved) < 40


def test_shards_against_a_plain_version(docs_of):
    """Sizes and checksums written out, slots by MD5, every slot in one shard, places gapless."""
    import hashlib
    import zlib

    _, base = texts(300, 2)
    rows = [(k, None if k % 50 == 0 else t + "é") for k, t in enumerate(base)]
    got = {r["doc_id"]: r for r in S.shard_documents(docs_of(rows), 24, 128).collect()}
    shard_of = {}
    for k, t in rows:
        raw = (t or "").encode()
        slot = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 128
        assert (got[k]["size"], got[k]["text_crc32"], got[k]["virtual_slot"]) == (len(raw) + 8, zlib.crc32(raw), slot)
        assert shard_of.setdefault(slot, got[k]["shard"]) == got[k]["shard"]


def test_shards_of_odd_rows(odd_docs, docs_of):
    rows = S.shard_documents(odd_docs.withColumn("slot", F.lit("old"))).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert S.shard_documents(docs_of([])).count() == 0
