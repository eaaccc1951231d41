import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofdesk.functions import text as T
from proofdesk.operators import ranking as R


def toks(t):
    return re.findall("[a-z0-9]+", t.lower())


def bm25(docs, query):
    ts = [toks(d) for d in docs]
    n, avg = len(ts), sum(map(len, ts)) / max(1, len(ts))
    df = Counter(t for d in ts for t in set(d))
    out = []
    for d in ts:
        tf, s = Counter(d), 0.0
        for t in toks(query):
            if tf[t]:
                s += float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * 2.5 / (tf[t] + 1.5 * (1 - 0.75 + 0.75 * len(d) / avg))
        out.append(s)
    return out


def best(scores, k, ids=None):
    ids = ids if ids is not None else range(len(scores))
    return sorted(zip(ids, scores), key=lambda x: (-x[1], x[0]))[:k]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["unit_ord"], r["score"]))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)]
    docs = [" ".join(r.choices(vocab, k=r.choice([0, 3, 20, 80]))) for _ in range(200)]
    docs += [docs[5]] * 80  # a hot copy
    return docs, [" ".join(r.choices(vocab, k=8)) for _ in range(12)] + ["", "unknownword", "w1 w1 w1 w2"]


@pytest.mark.parametrize("block, chunk", [(2000, 512), (3, 512), (2000, 7), (2000, 1)])
def test_bm25_equals_the_formula(spark, monkeypatch, texts, block, chunk):
    monkeypatch.setattr(R, "BLOCK_QUERIES", block)
    monkeypatch.setattr(R, "CHUNK_UNITS", chunk)
    docs, queries = texts
    units = spark.createDataFrame(list(enumerate(docs)), "unit_ord long, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    got = ranked(R.bm25_topk(units, qs, k=40))
    for q, text in enumerate(queries):
        want = best(bm25(docs, text), 40)
        assert [u for u, _ in got[q]] == [u for u, _ in want], text
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12, atol=0)


def test_hidden_units_change_the_statistics_of_their_corpus_only(spark, texts):
    docs, queries = texts
    rows = [(i, d, (["h1"] if i % 3 == 0 else []) + (["h2"] if i == 5 or i >= 200 else [])) for i, d in enumerate(docs)]
    units = spark.createDataFrame(rows, "unit_ord long, text string, hidden array<string>")
    qs = spark.createDataFrame([("a", queries[0], None), ("b", queries[0], "h1"), ("c", queries[0], "h2"), ("d", queries[0], "nothing hidden")],
                               "query_id string, text string, corpus_id string")
    got = ranked(R.bm25_topk(units, qs, k=30))
    for q, corpus in (("a", None), ("b", "h1"), ("c", "h2"), ("d", None)):
        seen = [(i, d) for i, d, h in rows if corpus not in h]
        want = best(bm25([d for _, d in seen], queries[0]), 30, [i for i, _ in seen])
        assert [u for u, _ in got[q]] == [u for u, _ in want], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12)


def test_chunks_that_cannot_reach_the_best_are_not_scored(monkeypatch):
    """40 strong units fill the best; of 50 later chunks only the one that holds a stronger unit is merged."""
    texts = [["rare", "rare"]] * 40 + [["rare", "plain", "plain", "plain"]] * 1000
    texts[700] = ["rare", "rare", "rare"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["unit_ord", "t"])
    stats = {("", ""): (1040, sum(map(len, texts))), ("", "rare"): (1040, 0)}
    merged = []
    monkeypatch.setattr(R, "CHUNK_UNITS", 20)
    monkeypatch.setattr(R.np, "lexsort", lambda keys, real=np.lexsort: merged.append(1) or real(keys))
    kernel = R._bm25_kernel([{"query_id": 1, "t": ["rare"], "corpus_id": None}], ["rare"], stats, 40, R.K1, R.B, None, pa.int64())
    (out,) = list(kernel(iter([batch])))
    assert out.column("unit_ord").to_pylist() == [700, *range(39)] and len(merged) == 3


@pytest.mark.parametrize("block", [2000, 3])
def test_scores_of_all_matching_units(spark, monkeypatch, texts, block):
    monkeypatch.setattr(R, "BLOCK_QUERIES", block)
    docs, queries = texts
    units = spark.createDataFrame([(i, d, ["x"] if i % 2 else None) for i, d in enumerate(docs)], "unit_ord long, text string, hidden array<string>").repartition(3)
    qs = spark.createDataFrame([(q, t, "x" if q == 1 else None) for q, t in enumerate(queries)], "query_id int, text string, corpus_id string")
    got = {(r["query_id"], r["unit_ord"]): r["score"] for r in R.bm25_scores(units, qs).collect()}
    want = {}
    for q, text in enumerate(queries):
        ids = [i for i in range(len(docs)) if q != 1 or i % 2 == 0]
        for i, score in zip(ids, bm25([docs[i] for i in ids], text)):
            if set(toks(docs[i])) & set(toks(text)):
                want[q, i] = score
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)


def test_cosine_of_all_units_and_of_those_at_a_minimum(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(60, 8))
    vectors[7] = 0
    units = spark.createDataFrame([(i, v.tolist(), ["x"] if i < 5 else None) for i, v in enumerate(vectors)], "unit_ord long, embedding array<double>, hidden array<string>")
    qs = spark.createDataFrame([(f"q{i}", vectors[i].tolist(), "x" if i == 0 else None) for i in range(4)], "query_id string, embedding array<double>, corpus_id string")
    length = np.clip(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9, None)
    cosine = (vectors / length) @ (vectors / length).T
    want = {(f"q{i}", j): cosine[i, j] for i in range(4) for j in range(60) if not (i == 0 and j < 5)}
    for minimum in (None, 0.3):
        got = {(x["query_id"], x["unit_ord"]): x["score"] for x in R.dense_scores(units, qs, minimum).collect()}
        kept = {k: v for k, v in want.items() if minimum is None or v >= minimum}
        assert got.keys() == kept.keys() and all(np.isclose(got[k], kept[k]) for k in kept)
    assert R.dense_scores(units.limit(0), qs).count() == 0 and R.bm25_scores(spark.createDataFrame([], "unit_ord long, text string"),
                                                                             spark.createDataFrame([(1, "a")], "query_id int, text string")).count() == 0


def test_counts_are_limited_to_what_the_queries_ask(spark):
    tokens = spark.createDataFrame([(["a", "b"], ["x", "y"]), (["a", "a"], None)], "t array<string>, hidden array<string>")
    qs = spark.createDataFrame([(1, ["a"], "x"), (2, ["b", "c"], None)], "query_id int, t array<string>, corpus_id string")
    got = {(r["corpus"], r["term"]): (r["n"], r["len"]) for r in R._term_counts(tokens, qs).collect()}
    assert got == {("", ""): (2, 4), ("", "a"): (2, 4), ("", "b"): (1, 2), ("x", ""): (1, 2), ("x", "a"): (1, 2)}


def test_empty_corpus_gives_no_rows(spark):
    units = spark.createDataFrame([], "unit_ord long, text string")
    assert R.bm25_topk(units, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_term_stats(spark):
    got = {r["term"]: (r["df"], r["idf"]) for r in R.term_stats(spark.createDataFrame(
        [(0, "a b b"), (1, "a"), (2, "")], "unit_ord long, text string")).collect()}
    assert got == {"a": (2, pytest.approx(math.log(1 + 1.5 / 2.5))), "b": (1, pytest.approx(math.log(1 + 2.5 / 1.5)))}


@pytest.mark.parametrize("block", [2000, 2])
def test_dense_and_fusion(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_QUERIES", block)
    r = np.random.default_rng(4)
    vecs = r.normal(size=(120, 16)).astype("float32")
    vecs[50:90] = vecs[7]
    vecs[3] = 0
    units = spark.createDataFrame([(i, v.tolist(), ["x"] if i == 7 else None) for i, v in enumerate(vecs)],
                                  "unit_ord long, embedding array<float>, hidden array<string>").repartition(4)
    qs = spark.createDataFrame([(i, vecs[i].tolist(), "x" if i == 7 else None) for i in (0, 7, 9)],
                               "query_id long, embedding array<float>, corpus_id string")
    got = ranked(R.dense_topk(units, qs, k=20, round_to=9))
    unit = vecs.astype(float) / np.clip(np.linalg.norm(vecs.astype(float), axis=1, keepdims=True), 1e-9, None)
    for q in (0, 7, 9):
        want = best([float(x) for x in np.round(unit @ unit[q], 9)], 120)
        want = [w for w in want if not (q == 7 and w[0] == 7)][:20]
        assert [u for u, _ in got[q]] == [u for u, _ in want]
    lists = [[4, 1, 2], [1, 9], [2, 1]]
    dfs = [spark.createDataFrame([(0, u, i) for i, u in enumerate(x)], "query_id long, unit_ord long, rank int") for x in lists]
    total = {}
    for x in lists:
        for i, u in enumerate(x):
            total[u] = total.get(u, 0.0) + 1.0 / (60 + i + 1)
    assert ranked(R.rrf(dfs))[0] == sorted(total.items(), key=lambda x: (-x[1], x[0]))
    assert ranked(R.rrf([dfs[0], dfs[0]]))[0][0][0] == 4


def test_scoring_shuffles_only_the_best(spark, texts):
    docs, queries = texts
    units = spark.createDataFrame(list(enumerate(docs)), "unit_ord long, text string")
    plan = R.bm25_topk(units, spark.createDataFrame([(0, queries[0])], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_queries_and_int_ids(spark):
    units = spark.createDataFrame([(0, "red fox", [1.0, 0.0]), (1, "blue hen", [0.0, 1.0])], "unit_ord long, text string, embedding array<float>")
    asked = spark.createDataFrame([(7, "fox", [1.0, 0.0])], "query_id int, text string, embedding array<float>")
    for rank in (R.bm25_topk, R.dense_topk):
        got = rank(units, asked, 1)
        assert [(g["query_id"], g["unit_ord"]) for g in got.collect()] == [(7, 0)] and dict(got.dtypes)["query_id"] == "int"
        assert rank(units, asked.where("query_id < 0"), 1).count() == 0


def test_tokens_cut_from_bytes_are_those_of_the_words(spark):
    r = random.Random(8)
    pieces = ["a", "B", "7", " ", "é", "K", "İ", "日", "\n", "-", "zz", "\x00", "ſ"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "end", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.lower("text").alias("low"), T.words(F.col("text")).alias("t")).orderBy("i").collect()
    column = pa.array([None, *(x["low"] for x in rows)], pa.string()).slice(1)
    length, toks = R._tokens(column)
    assert length.tolist() == [len(x["t"] or ()) for x in rows] and toks.to_pylist() == [t for x in rows for t in x["t"] or ()]
    assert R._tokens(column.slice(0, 0))[1].to_pylist() == [] and len(R._tokens(pa.array([None, ""], pa.string()))[0]) == 2


def test_a_chunk_scores_the_pairs_that_may_enter_alone(spark, monkeypatch):
    """Frequent terms in every chunk once made all its units be scored for each query, term by term."""
    r = random.Random(3)
    units = [(i, " ".join(r.choices(["the", "of", "and", f"w{i % 50}", f"x{r.randint(0, 300)}"], k=r.randint(0, 12)))) for i in range(3_000)]
    queries = [(q, " ".join(["the", "of", "and", f"w{q}", f"x{q}", "the", f"x{q + 9}"])) for q in range(20)]
    u, q = spark.createDataFrame(units, "unit_ord long, text string").coalesce(1), spark.createDataFrame(queries, "query_id long, text string")
    scores = {(x["query_id"], x["unit_ord"]): x["score"] for x in R.bm25_scores(u, q, round_to=6).collect()}
    want = {(i, at): e for i, _ in queries for at, e in enumerate(sorted(range(3_000), key=lambda n: (-scores.get((i, n), 0.0), n))[:40])}
    for cells in (4_000_000, 700):
        monkeypatch.setattr(R, "CHUNK_CELLS", cells)
        assert {(x["query_id"], x["rank"]): x["unit_ord"] for x in R.bm25_topk(u, q, round_to=6).collect()} == want
    seen = []
    monkeypatch.setattr(R.np, "lexsort", lambda keys, sort=np.lexsort: seen.append(len(keys[0])) or sort(keys))
    stats = {("", ""): (3_000, 18_000)} | {("", t): (1_000, 0) for t in ("the", "of")}
    batch = pa.RecordBatch.from_pydict({"unit_ord": list(range(3_000)), "t": [["the", "of"]] * 3_000})
    got = list(R._bm25_kernel([{"query_id": 1, "t": ["the", "of"], "corpus_id": None}], ["of", "the"], stats, 40, R.K1, R.B, None, pa.int64())(iter([batch])))
    assert got[0].column("unit_ord").to_pylist() == list(range(40)) and len(seen) == 1


def test_a_chunk_unfolds_the_terms_of_its_live_queries_alone():
    """5,000 terms of a query that the chunk cannot serve once made a dense row each."""
    import tracemalloc
    many = [f"w{i:04}" for i in range(5_000)]
    rows = [{"query_id": 1, "t": many, "corpus_id": None}, {"query_id": 2, "t": ["zz"], "corpus_id": None}]
    stats = {("", ""): (10_000, 100_000)} | {("", t): (10, 0) for t in (*many, "zz")}
    first = pa.RecordBatch.from_pydict({"unit_ord": [0, 1], "t": [many, ["zz"]]})
    rest = pa.RecordBatch.from_pydict({"unit_ord": range(2, 514), "t": [[many[1 + (10 * i + j) % 4_999] for j in range(10)] for i in range(511)] + [["zz", "zz"]]})
    run = R._bm25_kernel(rows, [*many, "zz"], stats, 1, R.K1, 0.0, 6, pa.int64())
    tracemalloc.start()
    got = list(run(iter([first, rest])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].column("unit_ord").to_pylist() == [0, 513] and peak < 10 << 20
