import random
import re
import tracemalloc

import numpy as np
import pytest

from loamgrid.llm import chosen_path as C
from loamgrid.llm.shingles import minwise, shingle_set


def plain_sets(pairs, words):
    out = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return out


def plain_components(pairs, words, percent):
    sets = plain_sets(pairs, words)
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                hi, lo = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    pairs, i = [], 0
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            pairs.append((i, " ".join(text)))
            i += 1
    return pairs


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("small", "block"), [(4, 5), (4096, 1024)])
def test_against_all_pairs(docs_of, small, block):
    pairs = corpus(3, 25, 14)
    out = C.near_duplicates(docs_of(pairs), words=4, percent=80, small=small, block=block)
    assert got(out) == plain_components(pairs, 4, 80)


def test_a_group_that_no_coordinate_parts(docs_of):
    base = [f"t{k}" for k in range(9000)]
    pairs = [(k, " ".join(base[: 4000 + k])) for k in range(9)]
    out = C.near_duplicates(docs_of(pairs), words=5, percent=80, small=3, block=4)
    assert got(out) == plain_components(pairs, 5, 80)


def test_recall_where_many_share_a_header(docs_of):
    header, pairs = [f"h{k}" for k in range(70)], []
    for k in range(300):  # two documents at exactly 0.8; those of other pairs are at 0.64
        body = header + [f"b{k}x{j}" for j in range(10)]
        pairs += [(2 * k + side, " ".join(body + [f"o{k}x{side}x{j}" for j in range(10)])) for side in (0, 1)]
    out = C.near_duplicates(docs_of(pairs), words=1, percent=80, trees=6, small=40, block=20)
    assert got(out) == {i: (90, i - i % 2) for i, _ in pairs}


def test_minwise_agreement_follows_similarity():
    """The share of equal values is the Jaccard similarity, with the spread of independent trials."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(1, 2**63, 64, dtype=np.uint64)
    for n, s in ((400, 0.8), (60, 0.8), (300, 0.3)):
        agree, both = [], round(n * s)
        for _ in range(400):
            u = rng.integers(0, 2**64, n, dtype=np.uint64)
            left, right = np.sort(u[: both + (n - both) // 2]), np.sort(np.r_[u[:both], u[both + (n - both) // 2 :]])
            agree.append((minwise(left, seeds) == minwise(right, seeds)).sum())
        assert abs(np.mean(agree) / 64 - s) < 0.02 and 0.8 < np.std(agree) / np.sqrt(64 * s * (1 - s)) < 1.2


def test_odd_rows(odd_docs, docs_of):
    rows = C.near_duplicates(odd_docs, words=5).collect()
    assert len(rows) == 9
    by = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert by[(1, 0)]["component_id"] == 1 and by[(2, 0)]["kept"]
    assert by[(3, 1)]["component_id"] == 3
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert C.near_duplicates(docs_of([])).count() == 0


def test_linked_pairs_between_blocks(monkeypatch):
    sets = [shingle_set(f"a b c d e f g h i j k {k % 2}", 3) for k in range(6)]
    plain = [(i, j) for i in range(3) for j in range(3) if 100 * len(np.intersect1d(sets[i], sets[3 + j])) >= 70 * len(np.union1d(sets[i], sets[3 + j]))]
    for hits in (1, 5, 1000):  # counted in parts or at once
        monkeypatch.setattr(C, "HITS", hits)
        assert [(i, k) for i, j in C.linked_pairs(sets[:3], 70, sets[3:]) for k in j.tolist()] == plain


@pytest.mark.parametrize("left", [60, 25])
def test_forest_of_close_rows_equals_all_pairs(left):
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 9, (6, 16)).astype(np.int32)
    mins = np.where(rng.random((60, 16)) < 0.2, rng.integers(0, 9, (60, 16)), heads[rng.integers(0, 6, 60)]).astype(np.int32)
    forest, comp = C.Forest(60), list(range(60))
    C._join_close(forest, mins, left, 11)
    for i in range(60):
        for j in range(i + 1, 60):
            if (left == 60 or i < left <= j) and (mins[i] == mins[j]).sum() >= 11:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert forest.parent.tolist() == comp
    a, b = forest.edges()
    assert len(a) == 60 - len(set(comp)) and all(comp[x] == y for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_a_full_node_of_copies_takes_little_memory():
    tracemalloc.start()
    forest = C.Forest(4096)
    C._join_close(forest, np.ones((4096, 64), np.int32), 4096, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not forest.parent.any() and peak < 40e6


def test_a_large_cluster_with_parts_outside_its_main_part(docs_of):
    rng = random.Random(9)
    body, pairs = [f"c{k}" for k in range(60)], []
    for k in range(80):  # near copies, and a chain that leads away from them by small steps
        text = list(body)
        text[rng.randrange(60)] = f"x{k}"
        pairs.append((k, " ".join(text)))
    for k in range(40):
        pairs.append((100 + k, " ".join([f"d{j}" for j in range(3 * k)][-60:] + body[3 * k :])))
    out = C.near_duplicates(docs_of(pairs), words=2, percent=80, block=16)
    assert got(out) == plain_components(pairs, 2, 80)
