"""Second-stage ordering of the fused candidates by a pluggable scorer or a listwise model reply.

A query has at most `CANDIDATES` rows here, so its candidates fit one array and one scorer call.
"""
from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T

# Fixed value: the score of a candidate that a reranker leaves out.
LEFT_OUT = -1000.0

Scorer = Callable[[str, Sequence[str]], Sequence[float]]


def _listed(candidates: DataFrame) -> DataFrame:
    """One row per query; its candidates as an array in fused order."""
    rest = [c for c in candidates.columns if c not in ("query_id", "question", "rank")]
    return (candidates.groupBy("query_id")
            .agg(F.first("question").alias("question"),
                 F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("cands")))


def _reordered(scored: DataFrame, honor_exclusions: bool) -> DataFrame:
    rows = scored.select("query_id", "question", F.posexplode("cands").alias("i", "c"), "scores")
    rows = rows.select("query_id", "question", "c.*", F.get("scores", F.col("i")).alias("rerank_score"))
    if honor_exclusions:
        rows = rows.where(F.col("rerank_score") > LEFT_OUT)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return rows.withColumn("position", F.row_number().over(w) - 1)


def rerank(candidates: DataFrame, scorer: Scorer, honor_exclusions: bool = True) -> DataFrame:
    """candidates(query_id, question, rank, unit_ord, text, ..) + rerank_score and final position.

    With `honor_exclusions` a candidate scored LEFT_OUT is dropped; without, it only sinks to the end.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def score(question: pd.Series, docs: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in scorer(q, list(d))] for q, d in zip(question, docs)])

    listed = _listed(candidates)
    return _reordered(listed.withColumn("scores", score("question", F.col("cands.text"))), honor_exclusions)


def numbered(docs) -> F.Column:
    """'[1] first', '[2] second', .. with blank lines between."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")


def listwise_requests(candidates: DataFrame, model: str, system: str, template: str) -> DataFrame:
    """(query_id, model, system, prompt): one ranking request per query; template holds {query} and {docs}."""
    before, rest = template.split("{query}")
    between, after = rest.split("{docs}")
    return _listed(candidates).select("query_id", F.lit(model).alias("model"), F.lit(system).alias("system"), F.concat(
        F.lit(before), "question", F.lit(between), numbered(F.col("cands.text")), F.lit(after)).alias("prompt"))


def ranking_scores(reply: Column, n: Column) -> Column:
    """Scores of candidates 1..n by the {"ranking": [..]} of a reply: 0 for the place first in the list, one less for each
    place after it, LEFT_OUT for a candidate that no whole number in the list names. Malformed JSON fails the job."""
    items = F.try_variant_get(F.parse_json(T.json_span(reply)), "$.ranking", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    numbers = F.transform(items, lambda v: F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
                          .when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")))  # JSON true is the number 1
    place = lambda i: F.coalesce(F.array_position(numbers, i.cast("bigint")), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(place(i) > 0, (1 - place(i)).cast("double")).otherwise(F.lit(LEFT_OUT))))


def rerank_listwise(candidates: DataFrame, replies: DataFrame, honor_exclusions: bool = True) -> DataFrame:
    """Apply replies(query_id, result) of `listwise_requests` to the candidates."""
    listed = _listed(candidates).join(replies.select("query_id", "result"), "query_id", "left")
    return _reordered(listed.withColumn("scores", ranking_scores(F.col("result"), F.size("cands"))).drop("result"), honor_exclusions)


def cross_encoder_scorer(model_name: str) -> Scorer:
    """A local model of the optional fastembed package; each Python worker loads it when it first scores."""
    @functools.cache
    def model():
        return importlib.import_module("fastembed.rerank.cross_encoder").TextCrossEncoder(model_name)

    return lambda question, passages: list(model().rerank(question, list(passages)))
