"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the
last return the columns of ``docs``; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.llm import chosen_path, exact_dedup, packing, quality, secrets
from flowmark.llm.common import documents, stored
from flowmark.llm.queries import labels, quality_held_out, tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the labels of its held-out part are not used."""
    return quality.of_good_quality(docs, labels(spark, sf_dir), quality_held_out)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.without_duplicates(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return chosen_path.without_near_duplicates(docs, shingle_words=5, similarity=0.8)


def secrets_hidden(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret and ``n_chars`` counted again."""
    hidden = secrets.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return hidden
    counted = F.coalesce(F.char_length("text"), "n_chars")
    return hidden.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1).drop("row")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equal),
    ("near dedup", one_of_near),
    ("secret scans", secrets_hidden),
    ("packing", packed),
]

#: No SQL: a fitted classifier and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
