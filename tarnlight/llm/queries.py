"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, exact_topk, html_template, jaccard_join, pii, secret_scan, sentencepiece_bpe, source_mix, span_sql, toxicity
from .common import read, spread


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.col("spans"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(spread(read(spark, sf_dir, "pages")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_documents(spread(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(spread(read(spark, sf_dir, "documents")), model_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spread(read(spark, sf_dir, "documents"))))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_topk.integers(read(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(rows, rows.filter("vec_id % 20 = 0"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(read(spark, sf_dir, "conversations"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spread(read(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spread(read(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(spread(read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_pii": span_sql.PII_SQL, "op6_exact_topk": exact_topk.SQL, "op7_chat_format": chat_format.SQL, "op8_jaccard_join": jaccard_join.SQL, "op9_exact_dedup": exact_dedup.SQL, "op10_secret_scan": span_sql.SECRETS_SQL}
