"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import anchors, cutting, minhash, positive_unlabelled, repetition
from tastemill.llm.shared import Cuts, crc_remainder, restored, tables

ACCEPTED = 0.3

# SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts, by their whole texts.

    An empty or null text is scored like any other; rows that repeat are judged each; extra columns
    pass through; an empty table stays one.
    """
    scorer = positive_unlabelled.learn(docs, tables(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    scored = positive_unlabelled.score(docs, scorer, carry=True)
    return restored(scored.where(F.col("score") >= ACCEPTED), docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the limits on length and repetition. A null or empty text has no words
    and goes; rows that repeat are judged each; extra columns pass through."""
    return restored(repetition.judge(docs, carry=True).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is 0.8 alike in five-word shingles: the smallest doc_id.

    Texts without words and rows without doc_id stay. Rows that repeat an id are one document and
    stay or go together.
    """
    dropped = minhash.groups(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 or more words that a smaller doc_id has.

    A text that loses nothing stays as it is; one that loses all its words becomes empty and stays
    a row. n_chars follows the text.
    """
    stripped = anchors.strip_repeats(docs, window=13, keep_layout=True)
    out = restored(stripped.withColumnRenamed("kept_text", "text"), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, a row for each piece. A null or empty text
    is its end id alone."""
    return cutting.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus, after all stages over the documents of ``sf_dir``."""
    docs = tables(spark, sf_dir, "documents")
    written = Cuts(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written.save(f"stage{i + 1}", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
