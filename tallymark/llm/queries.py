"""The queries of this package and their SQL twins, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, fill_middle, html_text, lines, mixing, near_dedup, outliers, pieces, pii, resampling, token_files, topk
from .toxicity import toxicity


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies, here and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(table(spark, sf_dir, "documents"))


def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.duplicate_spans(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_files.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_files.read(manifest, folder)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_outliers": op1_outliers,
    "op2_chunks": op2_chunks,
    "op3_pieces": op3_pieces,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_topk": op6_topk,
    "op7_pii": op7_pii,
    "op8_lines": op8_lines,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_html": op11_html,
    "op12_fill_middle": op12_fill_middle,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.SQL,
    "op6_topk": topk.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
