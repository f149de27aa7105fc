"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.chosen_path import near_duplicates
from loamgrid.llm.hard_negatives import hard_negatives
from loamgrid.llm.int8_join import embedding_links
from loamgrid.llm.licenses import scan_licenses
from loamgrid.llm.line_dedup import dedup_lines
from loamgrid.llm.media import media_digests
from loamgrid.llm.packing import pack_documents
from loamgrid.llm.prefix_trie import prefix_trie
from loamgrid.llm.quality import in_training as quality_training
from loamgrid.llm.quality import score_quality
from loamgrid.llm.sentencepieces import encode_documents
from loamgrid.llm.sharding import shard_documents
from loamgrid.llm.toxicity import in_training, score_toxicity, train_toxicity
from loamgrid.llm.warc import read_archive, write_archive
from loamgrid.plans.durable import checkpoint_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = train_toxicity(docs, _labels(spark, sf_dir))
    scored = score_toxicity(docs, model, score_col="score").drop("text")
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_webp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    scored = score_quality(docs, _labels(spark, sf_dir)).withColumnRenamed("quality_score", "score")
    made = ("evidence", "host_posterior", "path_posterior", "score")
    return scored.select("doc_id", (~quality_training(F.col("doc_id"))).alias("held_out"), *made, (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=4, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.array_join("kept_lines", "\n")
    dropped = (F.col("n_lines") - F.size("kept_lines")).cast("long")
    return out.select("doc_id", "n_lines", dropped.alias("n_dropped"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir)).drop("spans", "expressions")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = posixpath.join(checkpoint_dir(spark), f"slot-map-{uuid.uuid4().hex}")
    out = shard_documents(_documents(spark, sf_dir).select("doc_id", "text"), map_path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op11_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relabel=moved)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_webp_payloads": op2_webp_payloads,
    "op3_bayes_quality": op3_bayes_quality,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_cost_balanced_packing": op6_cost_balanced_packing,
    "op7_sentencepieces": op7_sentencepieces,
    "op8_embedding_links": op8_embedding_links,
    "op9_license_scan": op9_license_scan,
    "op10_virtual_slots": op10_virtual_slots,
    "op11_warc_shards": op11_warc_shards,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"

SQL: dict[str, str] = {
    "op8_embedding_links": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE {_COSINE} >= 0.9),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.y FROM r JOIN e ON e.x = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT c.vec_id, coalesce(n.k, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id""",
    "op4_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k+3], ' ') END AS sh
      FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS u(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 80 * (na.c + nb.c - i)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op5_line_dedup": """
WITH l AS (SELECT doc_id, k AS pos, string_split(coalesce(text, ''), chr(10))[k] AS line
           FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(k)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, d.key IS NOT NULL AND k.doc_id <> d.last AS gone FROM k LEFT JOIN d ON d.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_warc_shards": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op12_hard_negatives": """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = al QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> al AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END) AS crc FROM t),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:xor(h.crc, 4294967295) % 4], h.ts[xor(h.crc, 4294967295) % 4 + 1:]) AS ts FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS MATERIALIZED (SELECT conv_id, d, ts[1:d] AS p, len(ts) = d AS here FROM r, unnest(range(0, len(ts) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256 FROM m GROUP BY p),
c AS MATERIALIZED (SELECT n.*, q.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN len(regexp_extract_all(n.p[n.depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM n LEFT JOIN n q ON q.p = n.p[1:n.depth - 1] AND n.depth > 0),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM c WHERE depth > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT c.*, coalesce(n_children, 0) AS n_children FROM c LEFT JOIN k ON k.p = c.p),
s AS (SELECT f.p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM f, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s ON s.p = f.p""",
}
