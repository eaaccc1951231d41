"""The registered queries of the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunks, huffman, importance, jaccard, mixture, periods, pii, piececount, pivots, quality, toxicity, urls
from .oracle import ORACLE_SQL  # noqa: F401
from .tokens import tokenizer_file

WORD_BPE, WORD_BPE_IDS = "word_bpe_49k.json", 49_408
PIECE_BPE = "piece_bpe_32k.model"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman(spark, sf_dir):
    return huffman.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), WORD_BPE_IDS)


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.near_documents(table(spark, sf_dir, "documents"), 4, 85, 100)


def op3_quality_rules(spark, sf_dir):
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chunk_dedup(spark, sf_dir):
    return chunks.duplicate_spans(table(spark, sf_dir, "documents")).drop("twin")


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixture_packing(spark, sf_dir):
    return mixture.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op7_token_counts(spark, sf_dir):
    return piececount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE))


def op8_backtracking_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op9_pivot_index(spark, sf_dir):
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_url_trie(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periods.find_runs(table(spark, sf_dir, "documents"), rewrite=periods.repeated_tails).drop("runs")


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_huffman, op2_ngram_jaccard, op3_quality_rules, op4_chunk_dedup, op5_toxicity, op6_mixture_packing, op7_token_counts,
                                   op8_backtracking_bpe, op9_pivot_index, op10_url_trie, op11_personal_data, op12_periodic_runs, op13_importance_resampling)}
