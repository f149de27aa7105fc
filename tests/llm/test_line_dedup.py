import time
from collections import defaultdict

from pyspark.sql import functions as F

from loamgrid.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(pairs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(line.strip(BLANKS).translate(LOWER), ())
            if len(held) < min_docs or max(held) == i:
                kept.append(line)
        out.append((i, len(lines), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["n_lines"], "\n".join(r["kept_lines"])) for r in df.collect())


def test_against_plain(docs_of):
    shared = ["X" * 39 + "É", "y" * 41, "  " + "Y" * 41 + "\t\x0b", "z" * 39, "é" * 40]
    pairs = [(k, "\n".join([f"own {k}", *shared[: 1 + k % 5], "", shared[k % 5], "tail\n"])) for k in range(23)]
    assert got(dedup_lines(docs_of(pairs))) == plain(pairs)


def test_odd_rows(odd_docs, docs_of):
    rows = got(dedup_lines(odd_docs.where("doc_id is not null")))
    assert (1, 1, "") in rows and (2, 1, "") in rows and rows.count((3, 1, "a")) == 2
    assert dedup_lines(odd_docs).count() == 9
    assert dedup_lines(docs_of([])).count() == 0


def test_rows_that_repeat_an_id(docs_of):
    line = "q" * 50
    pairs = [(k, f"{line}\n{k}") for k in range(5)] + [(0, f"first\n{line}")]
    assert got(dedup_lines(docs_of(pairs))) == plain(pairs)


def test_clashing_columns_pass(docs_of):
    docs = docs_of([(1, "a"), (2, "b")]).withColumn("n_lines", F.lit("x")).withColumn("other", F.lit(3))
    assert {tuple(r) for r in dedup_lines(docs).select("doc_id", "n_lines", "other").collect()} == {(1, 1, 3), (2, 1, 3)}


def test_any_column_names_pass(docs_of):
    more = {c: F.lit(f"my {c}") for c in ("__id", "__lines", "__out", "id", "lines", "out", "key", "pos", "docs", "last", "c0", "c1")}
    line = "w" * 45
    docs = docs_of([(k, f"{line}\n{k}") for k in range(6)]).withColumns(more)
    rows = dedup_lines(docs).collect()
    assert all(r[c] == f"my {c}" for r in rows for c in more)
    assert {r["doc_id"]: r["kept_lines"] for r in rows} == {k: [line, "5"] if k == 5 else [str(k)] for k in range(6)}


def test_no_python_in_the_plan(docs_of):
    plan = dedup_lines(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_lines_of_one_text(docs_of):
    """Work follows a text's lines: 200,000 lines, half of which go, take seconds."""
    shared = [f"this long line has the number {k} and is found in every one of the texts" for k in range(2000)]
    big = "\n".join(shared[k % 2000] if k % 2 else f"own line {k}" for k in range(200_000))
    rows = [(i, "\n".join(shared)) for i in range(10, 15)] + [(1, big), (2, big)]
    began = time.time()
    got = {r["doc_id"]: r for r in dedup_lines(docs_of(rows)).collect()}
    assert time.time() - began < 60
    want = [f"own line {k}" for k in range(0, 200_000, 2)]
    assert got[1]["kept_lines"] == want and got[2]["kept_lines"] == want and got[1]["n_lines"] == 200_000
    assert got[14]["kept_lines"] == shared and got[10]["kept_lines"] == []
