"""A corpus pipeline of five stages over ``documents``.

quality classifier, toxicity, line deduplication, near deduplication, packing. Each stage works on all that
the one before kept, and its result is written as Parquet and read again for the next. All but the last
return the columns of ``documents``; extra columns of the input pass through as well.
"""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.chosen_path import near_duplicates
from loamgrid.llm.line_dedup import dedup_lines
from loamgrid.llm.packing import pack_documents
from loamgrid.llm.quality import score_quality
from loamgrid.llm.toxicity import score_toxicity, train_toxicity
from loamgrid.plans.durable import checkpoint_dir

#: Documents below the first or at and above the second are rejected.
LEAST_QUALITY, MOST_TOXICITY = 0.5, 0.5


#: The columns of ``documents``; any others travel under names that no operator uses.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its extra columns renamed, and the names to give back."""
    back = {f"__extra{k}": c for k, c in enumerate(docs.columns) if c not in COLUMNS}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined quality is at least LEAST_QUALITY."""
    rows, back = _apart(docs)
    kept = score_quality(rows, _labels(spark, sf_dir)).where(F.col("quality_score") >= LEAST_QUALITY)
    return kept.select(rows.columns).withColumnsRenamed(back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below MOST_TOXICITY, by a model trained on what is left of the labelled texts."""
    rows, back = _apart(docs)
    model = train_toxicity(rows, _labels(spark, sf_dir))
    kept = score_toxicity(rows, model, score_col="toxicity_score").where(F.col("toxicity_score") < MOST_TOXICITY)
    return kept.select(rows.columns).withColumnsRenamed(back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows the text. A null text stays null."""
    rows, back = _apart(docs)
    out = dedup_lines(rows)
    text = F.when(F.col("text").isNotNull(), F.array_join("kept_lines", "\n"))
    out = out.withColumn("text", text).drop("kept_lines", "n_lines")
    n_chars = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(rows.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8); null ids stay."""
    rows, back = _apart(docs)
    gone = near_duplicates(rows, words=5, percent=80).where("not kept").select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select(rows.columns).withColumnsRenamed(back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of at most 4096 tokens, with their ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No SQL: classifiers, minwise trees and a tokenizer; tests hold line dedup, near dedup and packing against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; results between stages are kept in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = posixpath.join(folder, str(k))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
