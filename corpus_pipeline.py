"""The corpus pipeline: each stage works on all that the one before it kept, through Parquet.

Edge cases are those of the operators; every stage takes null or empty texts, null ids, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import lines, mixing, near_dedup, pieces, queries
from tallymark.llm import toxicity as toxic
from tallymark.session import staged


#: Bytes of an Arrow batch. The stages' texts are long; Spark's own bound is 64 MB for each task on either side of the pipe to Python.
BATCH_BYTES = 4 << 20
#: Python workers are used again by later stages. With these settings of the C library and of Arrow, what one stage frees goes back to the system.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def bounded(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to `BATCH_BYTES`, unless it has a tighter bound, and let its Python workers give freed memory back."""
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    bounded(spark)
    return toxic.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from the texts; a document of which no word is left goes."""
    bounded(spark)
    return lines.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id."""
    bounded(spark)
    return near_dedup.drop_near_duplicates(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated by complete epochs, or left out."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded text of every row."""
    bounded(spark)
    coded = pieces.encode(docs, queries.tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

#: A trained stage has no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name.replace(' ', '-')}")
    return docs
