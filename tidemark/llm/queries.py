"""The queries that apply the operators of this subpackage to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann_forest, html_main, language_id, line_dedup, near_dedup, packing, secret_scan, sentencepiece_bpe, token_store, topk_slices
from tidemark.llm._common import scratch_path


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tiktoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_slices.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    token_store.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_main.extract(F.col("html"), spark).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def held_out() -> F.Column:
    """Documents that no language prototype may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    prototypes = language_id.fit(documents.where(~held_out()))
    found = language_id.predict(F.col("text"), prototypes, spark)
    return documents.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(F.col("text"), vocabulary("byte_bpe_50k.tiktoken"), tiktoken_pattern(), spark=spark)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("found")).select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256", "found.spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_line_dedup, op2_topk, op3_packing, op4_sentencepiece, op5_token_store, op6_html_main, op7_language_id, op8_nearest, op9_near_dedup, op10_secret_scan, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_topk": OP2_SQL}


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * r.e[i])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
