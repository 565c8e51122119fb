"""Registered queries of this package, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_utc
from . import blockjoin, fim, licenses, linededup, merkle, mixing, packing, quality, recompression, sigtree, simple8b, tokencounts, urlfilter
from .common import table
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


@query("op1_signature_tree_join")
def op1(spark, sf_dir):
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=75)


@query("op2_block_matrix_join", """
WITH v AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.embedding) = len(c.embedding))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
""")
def op2(spark, sf_dir):
    vectors = blockjoin.usable(table(spark, sf_dir, "embeddings"))
    return blockjoin.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op3_temperature_mixing", mixing.mixing_sql())
def op3(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "mix_tokens", "mix_epoch", "mix_block", "mix_place")


@query("op4_line_dedup", linededup.line_sql())
def op4(spark, sf_dir):
    cleaned = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@query("op5_cutting_stock_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@query("op6_redirect_equivalence")
def op6(spark, sf_dir):
    return urlfilter.judge_pages(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


@query("op7_two_tier_token_counts")
def op7(spark, sf_dir):
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


@query("op8_token_files")
def op8(spark, sf_dir):
    return simple8b.token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


@query("op9_recompression_dedup")
def op9(spark, sf_dir):
    return recompression.remove_repeats(table(spark, sf_dir, "documents"), window=50)


@query("op10_quality_rules")
def op10(spark, sf_dir):
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


@query("op11_prefix_filter_licenses", licenses.scan_sql())
def op11(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op12_displacement_fim", fim.fim_sql())
def op12(spark, sf_dir):
    outputs = fim.restore(fim.rearrange(table(spark, sf_dir, "documents")))
    return outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_interval_merkle", merkle.merkle_sql())
def op13(spark, sf_dir):
    return merkle.verify(table(spark, sf_dir, "documents"))
