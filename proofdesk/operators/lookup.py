"""Id lookups: strict ones fail on an unknown id, lenient ones fall back to the id itself."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_strict(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Add `value` from `table`; a key that `table` lacks fails the job when the row is produced."""
    hit = rows.join(table.select(key, F.col(value).alias("_v"), F.lit(True).alias("_hit")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    kind = table.schema[value].dataType
    return hit.withColumn(value, F.when(F.col("_hit"), F.col("_v")).otherwise(missing.cast(kind))).drop("_v", "_hit")


def lookup_lenient(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Add `value` from `table`, or the key as text where `table` lacks it."""
    hit = rows.join(table.select(key, value), key, "left")
    return hit.withColumn(value, F.coalesce(F.col(value), F.col(key).cast("string")))


def only_ids(rows: DataFrame, ids, key: str) -> DataFrame:
    """Restrict to a set of ids, given as a short list or as a DataFrame holding `key`."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(sorted(set(ids))))
