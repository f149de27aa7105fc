"""Ids over 2^53 beside a null, and columns of every type, come out of each Python operator as they went in."""

import datetime
import decimal

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as P
from loamgrid.llm.chosen_path import near_duplicates
from loamgrid.llm.int8_join import embedding_links
from loamgrid.llm.licenses import scan_licenses
from loamgrid.llm.media import decode_media, media_digests, store_texts
from loamgrid.llm.packing import pack_documents
from loamgrid.llm.quality import score_quality
from loamgrid.llm.sentencepieces import encode_documents
from loamgrid.llm.sharding import shard_documents
from loamgrid.llm.toxicity import score_toxicity, train_toxicity

IDS = [2**60 + 1, 2**60 + 2, None, 2**53 + 1, -(2**62) - 1, 5]
TEXTS = ["one two three four five six seven", "one two three four five six seven", "a null id", None, "", "another text altogether"]
OPERATORS = {
    "media": media_digests,
    "licenses": scan_licenses,
    "packing": lambda d: pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "pieces": lambda d: encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
    "near duplicates": near_duplicates,
    "shards": shard_documents,
    "media read": lambda d: decode_media(store_texts(d)),
}


@pytest.fixture
def docs(docs_of):
    return docs_of(list(zip(IDS, TEXTS, strict=True))).coalesce(1)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_stay(name, docs):
    assert sorted((r["doc_id"] for r in OPERATORS[name](docs).collect()), key=repr) == sorted(IDS, key=repr)


def test_text_ids(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    for name in sorted(OPERATORS):
        got = OPERATORS[name](named).select("doc_id").collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == sorted((None if i is None else f"doc-{i}" for i in IDS), key=repr), name
    near = {r["doc_id"]: r for r in near_duplicates(named).collect()}
    low = f"doc-{2**60 + 1}"
    assert near[f"doc-{2**60 + 2}"]["component_id"] == low and not near[f"doc-{2**60 + 2}"]["kept"] and near[low]["kept"]


def test_null_ids_link_with_nothing(docs_of, spark):
    got = {r["doc_id"]: r for r in near_duplicates(docs_of([(None, "a b c d e f"), (9, "a b c d e f"), (2**60 + 1, "a b c d e f")])).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"] is None and got[None]["n_shingles"] == 2
    assert got[2**60 + 1]["component_id"] == 9
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (2**60 + 2, [1.0, 0.0]), (2**60 + 1, [1.0, 1e-9]), ("7", [0.0, 1.0])][:3], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_links(vectors.coalesce(1)).collect()}
    assert got == {None: (2, None, None), 2**60 + 2: (2, 2**60 + 1, False), 2**60 + 1: (2, 2**60 + 1, True)}


def test_very_long_and_very_short_vectors(spark):
    rows = [("a", [1e200, 1e200]), ("b", [2e200, 2.1e200]), ("c", [1e-200, 1e-200]), ("d", [1.0, -1.0]), ("e", [1e-300, 1.1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {"a": (3, "a"), "b": (3, "a"), "c": (3, "a"), "e": (3, "a"), "d": (0, "d")}


EXTRA = T.StructType([
    T.StructField("evidence", T.LongType()), T.StructField("money", T.DecimalType(20, 3)), T.StructField("kept_lines", T.ArrayType(T.LongType())), T.StructField("seen", T.TimestampType()),
    T.StructField("raw", T.BinaryType()), T.StructField("of", T.StructType([T.StructField("a", T.LongType())])), T.StructField("a`b", T.ByteType()), T.StructField("row", T.LongType()),
])


@pytest.fixture
def wide(spark, docs_of):
    base = docs_of([(i, f"Text number {i} is here. It says little, and says it well enough.") for i in (2**60 + 1, 2**60 + 2, None, 7)])
    extra = [(2**60 + 3, decimal.Decimal("1.25"), [2**60 + 1, None], datetime.datetime(2020, 1, 2, 3, 4, 5), b"\x00\xff", (2**60 + 1,), 3, 2**60 + 5), (None,) * 8, (5, None, [], None, b"", (None,), None, None), (2**60 + 4, None, None, None, None, None, 1, 1)]
    fields = T.StructType([*base.schema.fields, *EXTRA.fields])
    return spark.createDataFrame([(*b, *e) for b, e in zip(base.collect(), extra, strict=True)], fields).coalesce(1)


def test_all_columns_pass_the_scorers(spark, wide, sf_dir):
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), wide.drop("evidence")
    want = sorted(repr(tuple(r)) for r in docs.collect())
    for out in (score_toxicity(docs, train_toxicity(docs, labels)), score_quality(docs, labels)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert sorted(repr(tuple(r)[: len(docs.columns)]) for r in out.collect()) == want


def test_all_columns_pass_the_pipeline(spark, wide, sf_dir):
    docs = wide
    want = {repr(tuple(r)) for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = {repr(tuple(r)) for r in out.collect()}
        assert got <= want and (got or name == "quality classifier"), name
        docs = out if got else docs
