"""A training-data pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on what the stage before wrote, and its decisions take effect; all but the last return
the columns of ``documents``. ``n_chars`` is kept in step with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linededup, mixing, packing, quality, sigtree
from millrace.llm.common import stored, table
from millrace.llm.tokens import tokenizer_path
from millrace.session import pin_utc

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fitted trees."""
    return quality.keep_good(docs.select(*COLUMNS), table(pin_utc(spark), sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines on more than a tenth of their source's documents, three at least; no document is dropped."""
    cleaned = linededup.drop_boilerplate(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.75, the smallest doc_id stays.

    Rows with one doc_id and different texts, or without doc_id, are documents of their own; of equal rows one stays.
    """
    return sigtree.one_of_each_group(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each epoch a document takes part in."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_duplicate_stage),
          ("source_mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL: the quality rules fit a model and packing uses a tokenizer. The tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(pin_utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
