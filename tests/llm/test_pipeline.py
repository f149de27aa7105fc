import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from loamgrid.llm.quality import score_quality
from loamgrid.llm.toxicity import score_toxicity, train_toxicity


def test_stages_keep_columns_and_only_drop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept_lines", F.lit(1)).withColumn("evidence", F.lit("x"))
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.4 * len(ids)
        docs, ids = spark.createDataFrame(out.collect(), out.schema), left
    packed = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_odd_rows_pass_every_stage(spark, odd_docs, docs_of, sf_dir):
    for docs in (odd_docs, docs_of([])):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_line_stage_against_plain(spark, docs_of, sf_dir):
    long = "this line is long enough to be counted, so it goes"
    texts = {i: "\n".join([f"own line of {i}", f"  {long.upper()} ", "", long if i % 2 else "short", f"tail {i}"]) for i in range(9)}
    texts |= {20: None, 21: "", 22: long}
    keys = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                keys.setdefault(key(line), set()).add(i)
    gone = {k: max(ids) for k, ids in keys.items() if len(ids) >= 5}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in P.line_stage(spark, docs_of(list(texts.items())), sf_dir).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and gone
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())


def test_near_duplicate_stage_against_all_pairs(spark, docs_of, sf_dir):
    rng = random.Random(4)
    texts = {}
    for k in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for copy in range(rng.choice([1, 1, 2, 4])):
            w = list(words)
            for _ in range(copy):
                w[rng.randrange(60)] = "x"
            texts[len(texts)] = " ".join(w)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in texts.items()}
    group = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = min(group[i], group[j])
    kept = {r["doc_id"] for r in P.near_duplicate_stage(spark, docs_of(list(texts.items())), sf_dir).collect()}
    assert kept == {i for i in texts if group[i] == i} and len(kept) < len(texts)


def test_packing_stage_keeps_every_token(spark, docs_of, sf_dir):
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: f"document {i} " * (i * 40 + 1) for i in range(30)} | {30: None, 31: "long " * 9000}
    pieces = P.packing_stage(spark, docs_of(list(texts.items())), sf_dir).collect()
    for i, t in texts.items():
        mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        want = np.asarray([*tokens.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(bytes(r["ids"]) for r in mine) == want
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096


def test_quality_and_toxicity_stages_follow_their_scores(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in score_quality(docs, labels).where(F.col("quality_score") >= 0.5).select("doc_id").collect()}
    assert {r["doc_id"] for r in P.quality_stage(spark, docs, sf_dir).collect()} == good
    clean = {r["doc_id"] for r in score_toxicity(docs, train_toxicity(docs, labels), score_col="s").where(F.col("s") < 0.5).select("doc_id").collect()}
    assert {r["doc_id"] for r in P.toxicity_stage(spark, docs, sf_dir).collect()} == clean


def test_registered():
    assert {"pipeline", *(f"op{n}_" for n in range(1, 14))} <= {"pipeline"} | {k.split("_")[0] + "_" for k in __spark_entry__.queries() if k.startswith("op")}
