"""A corpus pipeline of five stages: language ID, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's docs; all but the last
return the columns of documents. SQL cannot express the stages, so ORACLE_SQL is None and tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm import common, lang_id, line_dedup, mixing, ngram_join, sp_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; lang becomes the language found. A null text has none."""
    return lang_id.keep_identified(docs).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from the texts; n_chars follows, and documents of which nothing is left go."""
    d = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id. Similarity 0.8, five-word shingles; no pair is missed."""
    return ngram_join.keep_one(docs, jaccard=0.8, width=5).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids."""
    return sp_codec.encode_documents(docs, spark.conf.get("spark.cohortica.tokenizer", sp_codec.MODEL)).select("doc_id", "lang", "source", "pieces", "n_pieces", "lossless")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. The table before the last stage stays until common.release() or the end of the session's folder: the result is read from it."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.written(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, f"stage{k}")
            # what the stage read and wrote on its way is not needed any more
            common.release(spark, 1, start)
    return docs
