"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct words and the beginnings of its longer words. A logistic regression is fitted on a bounded sample of
labelled documents (SAMPLE rows of each class, by hash of the id) over the FEATURES features that tell the classes apart best there: in LEAST_ROWS rows or more, by a chi-square above LEAST_CHI.
For each sampled document that names a group, the group terms of its sentences are swapped for other terms of the same kind, and the squared
change of the score is penalised, so that mentioning a group does not make a text toxic. All documents are scored.

Defined results: a null text is empty; an empty text gets the score of no feature; labels other than 0 and 1 are ignored, and of labels that
contradict each other the toxic one counts; if only one class is labelled, the scores lean to it without regard to the text; without any label each score is 0.
Repeated rows stay; of texts that share a labelled id, the one with the smallest digest is learnt from; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .base import Memo, Words, slices, texts, written

SAMPLE = 6_000
FEATURES = 8_192
LEAST_ROWS, LEAST_CHI = 3, 12
STEPS = 150
RIDGE = 2e-4
FAIRNESS = 5.0
#: Terms for groups of people, by kind; a term is swapped for the next of its kind.
GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["gay", "straight"], ["lesbian", "heterosexual"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["african", "european", "american"], ["immigrants", "natives"], ["disabled", "abled"], ["old", "young"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "einheimische"], ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["étrangers", "français"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "españoles"],
]
SWAP = {term: kind[(i + 1) % len(kind)] for kind in GROUPS for i, term in enumerate(kind)}
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    return [word] + [f"^{word[:k]}" for k in (4, 5) if len(word) > k]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def held_out():
    """The remainder of crc32(doc_id as text) by 5 is 0: never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, features, swapped: the features after swapping, or null) of at most `sample` labelled documents of each class."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .where(~held_out()))
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = (texts(docs).join(F.broadcast(chosen), "doc_id")  # 2 * sample ids at most are broadcast
            .groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic"))

    def run(batches):
        for batch in slices(batches):
            plain, swapped = [], []
            for text in batch.column("text").to_pylist():
                words = set(WORD.findall(text.lower()))
                plain.append(sorted(features(words)))
                named = words & SWAP.keys()
                swapped.append(sorted(features((words - named) | {SWAP[w] for w in named})) if named else None)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(plain, pa.list_(pa.string())), pa.array(swapped, pa.list_(pa.string()))],
                                             ["toxic", "features", "swapped"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, features array<string>, swapped array<string>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, fairness: float = FAIRNESS) -> tuple[dict[str, float], float]:
    """(weight by feature, intercept)."""
    rows = written(training_rows(docs, labels, sample), "toxic-sample")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    share = (labels.where("toxic in (0, 1)").where(~held_out()).agg(F.avg("toxic")).first()[0] or 0.0)
    if not n1 or not n0:
        return {}, (4.0 if n1 else -4.0 if n0 else -40.0)
    found = (rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")))
    # the chi-square of feature and class; seldom features and weak ones are left out
    b = F.col("n") - F.col("a")
    chi = ((F.col("a") * (n0 - b) - b * (n1 - F.col("a"))) ** 2 * float(n0 + n1)
           / (F.col("n").cast("double") * (n0 + n1 - F.col("n")).cast("double") * float(n1) * float(n0)))
    top = found.where(F.col("n") >= LEAST_ROWS).where(F.col("n") < n0 + n1).withColumn("chi", chi).where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "f").limit(most)
    names = [r["f"] for r in top.select("f").collect()]  # `most` at most
    number = {f: i for i, f in enumerate(sorted(names))}

    def pick(batches):
        for batch in batches:
            columns = [[x and sorted(number[f] for f in x if f in number) for x in batch.column(c).to_pylist()] for c in ("features", "swapped")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic")] + [pa.array(c, pa.list_(pa.int32())) for c in columns], ["toxic", "features", "swapped"])

    # at most 2 * sample rows of selected feature numbers
    taken = rows.mapInArrow(pick, "toxic int, features array<int>, swapped array<int>").toArrow()
    y = taken.column("toxic").to_numpy().astype(float)
    weights, bias = regress(taken.column("features").to_pylist(), taken.column("swapped").to_pylist(), y, len(number), fairness)
    prior = min(max(share, 1e-4), 1 - 1e-4)  # the sample's classes are not in their true proportion
    bias += np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return {f: float(weights[i]) for f, i in number.items() if weights[i]}, float(bias)


def regress(plain: list, swapped: list, y: np.ndarray, width: int, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge and the penalty on counterfactual changes, by Adam over all rows."""
    size = np.array([len(x) for x in plain])
    at, col = np.repeat(np.arange(len(plain)), size), np.array([i for x in plain for i in x], dtype=np.int64)
    # rows of the change that swapping makes: +1 for new features, -1 for lost ones
    pairs = [(set(a), set(b)) for a, b in zip(plain, swapped) if b is not None]
    moved = [(r, i, s) for r, (a, b) in enumerate(pairs) for s, d in ((1.0, b - a), (-1.0, a - b)) for i in sorted(d)]
    m_at, m_col = (np.array([m[k] for m in moved], dtype=np.int64) for k in (0, 1))
    m_sign = np.array([m[2] for m in moved])
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], len(y)) + b, -30, 30)))
        err = (p - y) / len(y)
        grad = np.bincount(col, err[at], width) + 2 * RIDGE * w
        if len(moved):
            change = np.bincount(m_at, m_sign * w[m_col], len(pairs))
            grad += fairness * 2 * np.bincount(m_col, m_sign * change[m_at], width) / len(pairs)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def scorer(weights: dict[str, float], bias: float):
    """A function from an Arrow string array without nulls to scores."""
    names = list(weights)
    number, value = {f: i for i, f in enumerate(names)}, np.array([weights[f] for f in names] or [0.0])

    def of_word(word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace").lower()
        return [number[f] for w in WORD.findall(text) for f in features_of(w) if f in number]

    memo = Memo(of_word)

    def score(column: pa.Array) -> np.ndarray:
        words = Words(column, lower=True)
        memo.alone()
        hits = [memo[w] for w in words.distinct]
        size = np.fromiter(map(len, hits), dtype=np.int64, count=len(hits))
        doc = np.repeat(np.arange(len(words)), np.diff(words.bounds))
        some = size[words.codes] > 0
        # each feature of a document once
        pairs = np.unique(doc[some] * len(size) + words.codes[some]) if some.any() else np.zeros(0, np.int64)
        code = pairs % max(1, len(size))
        at = np.repeat(pairs // max(1, len(size)), size[code])
        col = np.array([i for c in code.tolist() for i in hits[c]], dtype=np.int64)
        keys = np.unique(at * len(value) + col) if len(col) else np.zeros(0, np.int64)
        z = bias + np.bincount(keys // len(value), value[keys % len(value)], len(words))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights, bias = fit(docs, labels, **options)

    def run(batches):
        score = scorer(weights, bias)
        for batch in slices(batches):
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names: a row travels as one value beside its text."""
    weights, bias = fit(docs, labels, **options)

    def run(batches):
        score = scorer(weights, bias)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(score(batch.column("text")) < 0.5))], ["row"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")
