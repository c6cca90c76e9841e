"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitally.llm import byte_bpe, decontamination, kneser_ney, line_dedup, simhash_dedup
from epitally.llm.common import shared_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language; the others go."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return kneser_ney.kept(docs, trusted)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share; ``n_chars`` follows the text.

    A text from which nothing goes stays as it is, a null one too.
    """
    out = line_dedup.drop_repeated_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    count = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": count}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Of rows that share this id one stays; a group without any id keeps one row.
    """
    return simhash_dedup.first_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to four fifths of its shingles; the others go."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids`` and ``n_bytes``, the length of the ids decoded."""
    pairs = byte_bpe.byte_pairs(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    out = byte_bpe.coded(docs, pairs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("byte-level BPE", tokens),
]

# A trained model and the merges of a vocabulary have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
