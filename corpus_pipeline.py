"""The corpus pipeline: STAGES applied to ``documents`` one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of documents, extra ones too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.llm import bpe, mixing, passages, sketches, toxicity
from patchloom.session import pin

REJECT_FROM = 0.5  # toxicity score
SIMILARITY = 80  # percent of Jaccard similarity from which documents are near-duplicates
MIX_WEIGHTS, MIX_TOTAL, MIX_MOST = (3, 1, 2), 1.5, 2


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; weights are learned from the labels outside the held-out fold."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "__toxicity"
    while score in (c.lower() for c in docs.columns):
        score += "_"
    return toxicity.add_scores(docs, scorer, "text", score).filter(F.col(score) < REJECT_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return sketches.drop_near_duplicates(docs, percent=SIMILARITY)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 35 and more words that recur; all documents stay."""
    return passages.strip_passages(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document none, one or two times, so that sources come to their targets."""
    return mixing.mix_rows(docs, MIX_WEIGHTS, MIX_TOTAL, MIX_MOST)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids, and whether they decode to the text.

    The ids are stored before they are decoded: a task that did both would hold two Python workers,
    which stay with their executor for all stages that follow. Decoded bytes and text are compared
    by SHA-256, so that texts need not be stored again.
    """
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), vocabulary, "text", "ids")
    coded = pin(coded.select("doc_id", "lang", "source", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    back = bpe.decode(coded, vocabulary, "ids", "decoded")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_passages),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: SQL can't express decoding, sketches and dependent rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written once below ``spark.checkpoint.dir`` and the next one reads that table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
