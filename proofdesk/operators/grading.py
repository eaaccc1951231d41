"""Grader replies to graded rows, and the counts reported from them."""
from __future__ import annotations

import json
import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# The outcomes a grader may give, the readers that are compared, and the list cut.
OUTCOMES = ("correct", "unsupported", "lost condition", "clarified", "needless escalation", "incomplete")
PAIRS = (("A", "B"), ("A", "C"), ("B", "C"))
MAX_PHRASES = 2

OBJECT = re.compile(r"\{.*\}", re.DOTALL)  # from the first brace to the last

GRADE = StructType([StructField("outcome", StringType()), StructField("evidence", StringType()),
                    StructField("keeps", ArrayType(StringType())), StructField("loses", ArrayType(StringType())),
                    StructField("extras", MapType(StringType(), StringType()))])


def phrases(value) -> list[str]:
    """The first phrases of a list; of a string, its first characters."""
    return list(map(str, islice(value or (), MAX_PHRASES)))


def read_grade(reply: str) -> dict:
    """The columns of GRADE from a reply with a JSON object somewhere in it."""
    body = OBJECT.search(reply)
    fields: dict = json.loads(body.group()) if body else {}
    if fields.get("outcome") not in OUTCOMES:
        raise ValueError(f"this reply grades with none of the known outcomes: {reply!r}")
    row = {"outcome": fields["outcome"], "evidence": f"{fields.get('evidence', '')}"}
    row |= {side: phrases(fields.get(side)) for side in ("keeps", "loses")}
    rest = fields.keys() - row.keys()
    return row | {"extras": {name: x if isinstance(x := fields[name], str) else json.dumps(x) for name in fields if name in rest}}


@F.pandas_udf(GRADE)
def parse_grade(reply: pd.Series) -> pd.DataFrame:
    """struct<outcome,evidence,keeps,loses,extras>; a reply that cannot be graded fails the job."""
    return pd.DataFrame([read_grade(r) for r in reply], columns=GRADE.names)


def success(outcome: Column, clarify_ok: Column) -> Column:
    return (outcome == "correct") | (F.coalesce(clarify_ok, F.lit(False)) & (outcome == "clarified"))


def outcome_summary(graded: DataFrame) -> DataFrame:
    """(experiment, reader, measure, count): n, success and every outcome that occurs; absent ones have no row."""
    counts = graded.groupBy("experiment", "reader", "outcome").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"))
    measures = F.array(F.struct(F.lit("n").alias("measure"), F.col("n").alias("count")),
                       F.struct(F.lit("success").alias("measure"), F.col("ok").alias("count")),
                       F.struct(F.col("outcome").alias("measure"), F.col("n").alias("count")))
    return (counts.select("experiment", "reader", F.inline(measures))
            .groupBy("experiment", "reader", "measure").agg(F.sum("count").alias("count")))


def paired(graded: DataFrame, pairs=PAIRS) -> DataFrame:
    """(experiment, pair, wins, losses, ties, n) over the cases that have both readers.

    graded(experiment, case, reader, success, row_ord). Of repeated (experiment, case, reader) rows the last
    one by row_ord counts; every step is a map-side combined aggregate.
    """
    readers = sorted({r for p in pairs for r in p})
    last = [F.max_by(F.when(F.col("reader") == r, F.col("success")),
                     F.when(F.col("reader") == r, F.col("row_ord"))).alias(f"r_{r}") for r in readers]
    wide = graded.where(F.col("reader").isin(readers)).groupBy("experiment", "case").agg(*last)
    sides = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(f"r_{a}").alias("a"), F.col(f"r_{b}").alias("b"))
                      for a, b in pairs])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return (wide.select("experiment", F.inline(sides)).groupBy("experiment", "pair")
            .agg(F.count_if(both & F.col("a") & ~F.col("b")).alias("wins"),
                 F.count_if(both & F.col("b") & ~F.col("a")).alias("losses"),
                 F.count_if(both & (F.col("a") == F.col("b"))).alias("ties"),
                 F.count_if(both).alias("n")))
