"""Queries of the text operators with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidewake.plans.ship import ship

from . import byte_bpe, collocations, html_text, packing, periodic, pii, quality, secrets, simhash, token_files, topk, toxicity, urls
from .common import scratch_path


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.digests(token_files.read(spark, path))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digests(html_text.extract(table(spark, sf_dir, "pages")))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(periodic.find(docs, seed=F.crc32(F.col("doc_id").cast("string"))))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_topk, op3_token_files, op4_toxicity, op5_byte_bpe, op6_urls, op7_simhash, op8_quality, op9_pii, op10_html_text, op11_periodic, op12_secrets, op13_collocations)}
ORACLE: dict[str, str] = {
    "op6_urls": urls.oracle(),
    "op11_periodic": periodic.oracle(),
    "op12_secrets": secrets.oracle(),
    "op13_collocations": collocations.oracle(),
    "op2_topk": """
with fit as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from fit q join fit c on c.vec_id <> q.vec_id and len(c.x) = len(q.x) where q.vec_id % 50 = 0),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
}
