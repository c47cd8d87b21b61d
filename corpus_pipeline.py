"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` writes each result to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import contamination, lines, sentence_pieces, similar, toxicity
from shelfmark.llm.queries import tokenizer_path
from shelfmark.session import settle


def lean(spark: SparkSession) -> None:
    """Rows go to the workers a thousand or four megabytes at a time: executors keep buffers of the largest batch they
    have had, and five stages run in the same ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    lean(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes if nothing but repeated lines was in it. n_chars follows the text."""
    left = lines.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    lean(spark)
    return similar.drop_similar(docs, similarity=0.8, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    lean(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.find_contamination(docs, items, size=13, one_in=20).where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, checked against the library and decoded again."""
    lean(spark)
    made = sentence_pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    return made.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentence_pieces", encode),
]

#: SQL has no learnt models, hashes of this kind or tokenizers; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
