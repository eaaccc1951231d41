"""Seeded sample that equals Python's random.sample over the sorted pool, without gathering the pool."""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_WORDS = 25
RANGES, GROUP = 1_024, 32  # splitters, and how many are searched together


def pool(entries: DataFrame, urls, min_words: int = MIN_WORDS) -> DataFrame:
    """Entries of the configured pages whose answer has at least min_words words."""
    return entries.where(F.col("url").isin(sorted(set(urls))) & (T.nwords(F.col("answer")) >= min_words))


def seeded_sample(rows: DataFrame, n: int, seed: int, *order: str) -> DataFrame:
    """n rows + sample_ord. random.sample depends on the population size only, so the positions are drawn on the driver; n beyond
    the population raises, as random.sample does.

    The rows at these positions are selected without sorting the rest: sampled splitters cut the order into ranges, one pass counts them,
    and only ranges that hold a position are ordered, equal keys counted first. Nothing is checkpointed: splitters are values of the plan.
    """
    keys = rows.select(*order)
    ranges = _range_of(keys, order)
    counts = sorted(keys.groupBy(ranges.alias("r")).count().collect())  # one row a range
    wanted = iter(sorted((p, s) for s, p in enumerate(random.Random(seed).sample(range(sum(c["count"] for c in counts)), n))))
    places, before, item = [], 0, next(wanted, None)
    for c in counts:
        while item and item[0] < before + c["count"]:
            places.append((c["r"], item[0] - before, item[1]))
            item = next(wanted, None)
        before += c["count"]
    spot = rows.sparkSession.createDataFrame(places, "_r int, _at long, sample_ord int")
    inside = keys.withColumn("_r", ranges).join(F.broadcast(spot.select("_r").distinct()), "_r")  # both sides have at most RANGES values
    upto = F.sum("_n").over(Window.partitionBy("_r").orderBy(*order))
    tallied = inside.groupBy("_r", *order).agg(F.count("*").alias("_n")).withColumn("_to", upto)
    chosen = (tallied.join(F.broadcast(spot), "_r").where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_n")))
              .select(*order, "sample_ord"))
    return rows.join(F.broadcast(chosen), list(order))  # n keys


def _range_of(keys: DataFrame, order: tuple[str, ...]) -> Column:
    """Number of the range a key lies in: how many sampled splitters do not exceed it, counted among those at the head of a group first."""
    key = F.struct(*order)
    drawn = keys.orderBy(F.xxhash64(*order, F.monotonically_increasing_id())).limit(RANGES)
    splitters = [r["s"] for r in drawn.orderBy(*order).select(F.to_json(key).alias("s")).collect()]
    groups = [splitters[i:i + GROUP] for i in range(0, len(splitters), GROUP)]
    kind = keys.select(key.alias("k")).schema["k"].dataType.simpleString()

    def upto(array: Column) -> Column:
        return F.coalesce(F.size(F.filter(array, lambda s: s <= key)), F.lit(0))

    def parsed(text: str, nested: str) -> Column:
        return F.from_json(F.lit(text), nested)

    heads = parsed(f"[{','.join(g[0] for g in groups)}]", f"array<{kind}>")
    every = parsed(f"[{','.join('[' + ','.join(g) + ']' for g in groups)}]", f"array<array<{kind}>>")
    group = upto(heads) - 1
    return F.when(group < 0, 0).otherwise(group * GROUP + upto(F.get(every, group))).cast("int")
