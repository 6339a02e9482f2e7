"""Corpus pipeline over ``documents``: fit texts, without repeated passages, near
copies and benchmark items, packed into token sequences.

Each stage gets all rows that its predecessor kept and returns the columns of
documents, the last one pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, linededup, packing, quality, resemblance
from eventloom.llm.common import table, tokenizer_path, written
from eventloom.llm.queries import KEEP_FROM


def fit_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).where(F.col("_x_score") >= KEEP_FROM).drop("_x_score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of line passages seen before; a document of nothing else
    stays as an empty text. ``n_chars`` follows the text."""
    out = linededup.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("_x_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: SimHash fingerprints
    at most 3 bits apart, or five-word shingles of similarity 0.8."""
    return resemblance.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = decontam.load_items(table(spark, sf_dir, "benchmark"))
    return decontam.with_hits(docs, items).where(F.size("_x_hits") == 0).drop("_x_hits")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", fit_texts),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed_sequences),
]

#: the classifier, fingerprints and tokenizer have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that all stages leave of ``documents``.

    Null texts count as empty and are fit; texts without words are copies of each other,
    of which the one of the smallest id stays. Rows without an id stay in the stage of
    near copies and are packed under a null id; rows that repeat an id stay or go together
    there. Without labels the classifier rests on its labellers alone, without benchmark
    items no document is dropped for them. Empty documents give no pieces. Other columns
    are carried up to the last stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
