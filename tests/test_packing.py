import random
import re

import pytest
from pyspark.sql import functions as F

from proofdesk.functions import text as T
from proofdesk.operators import packing as K
from proofdesk.operators import rerank as RR
from proofdesk.operators.extract import WINDOW_BITS

WINDOW = 1 << WINDOW_BITS


def sents(t):
    return [p.strip() for line in t.split("\n") for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", line) if p.strip()]


def spans(n):
    return [list(range(n))] if 0 < n <= 3 else [list(range(i, min(i + 3, n))) for i in range(0, n - 1, 2)] if n else []


def head(e):
    return f"[{e[1]} | page updated {e[2][:10]} | entry: {e[3]}]"


def render(entry, windows):
    """The rendered block, from the list of sentences the windows cover."""
    s = sents(entry[4])
    covered = [i in {j for k in windows for j in spans(len(s))[k]} for i in range(len(s))]
    out, gap = "", False
    for i, on in enumerate(covered):
        if on:
            out += (" " if out else "") + ("[...] " if gap and out else "") + s[i]
            gap = False
        else:
            gap = True
    return head(entry) + "\n" + out


def expect_v2(entries, ranked, budget):
    taken, order = {}, []
    text = lambda t: "\n\n".join(render(entries[e], t[e]) for e in t)
    for u in ranked:
        e, k = divmod(u, WINDOW)
        n = len(spans(len(sents(entries[e][4]))))
        new = {j for j in (k - 1, k, k + 1) if 0 <= j < n} - taken.get(e, set())
        if new:
            trial = {**taken, e: taken.get(e, set()) | new}
            if len(text(trial).split()) <= budget:
                taken = trial
    return text(taken)


def expect_v1(entries, ranked, budget):
    taken, used = {}, 0
    for u in ranked:
        e, k = divmod(u, WINDOW)
        s = sents(entries[e][4])
        w = [" ".join(s[i] for i in x) for x in spans(len(s))]
        new = {j for j in (k - 1, k, k + 1) if 0 <= j < len(w)} - taken.get(e, set())
        cost = sum(len(f"{head(entries[e])} {w[j]}".split()) for j in new)
        if new and used + cost <= budget:
            taken[e] = taken.get(e, set()) | new
            used += cost
    out = []
    for e, ks in taken.items():
        s = sents(entries[e][4])
        out.append(head(entries[e]) + "\n" + " [...] ".join(" ".join(s[i] for i in spans(len(s))[k]) for k in sorted(ks)))
    return "\n\n".join(out)


@pytest.mark.parametrize("version,expect", [(2, expect_v2), (1, expect_v1)])
def test_passages_against_plain_rendering(spark, version, expect):
    r = random.Random(version)
    entries = [(i, f"https://p{i % 3}/", "2024-05-06T00:00:00", f"Title {i} of it",
                " ".join(f"{'Word ' * r.randint(1, 6)}{i}x{j}." for j in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 9, 12, 20])]
    units = [i * WINDOW + k for i, e in enumerate(entries) for k in range(len(spans(len(sents(e[4])))))]
    df = spark.createDataFrame(entries, "entry_ord long, url string, modified string, question string, answer string")
    got_units = {x["unit_ord"]: x["text"] for x in K.passage_units(df).collect()}
    assert sorted(got_units) == units
    for budget in (15, 40, 60, 90, 200):
        queries = {q: r.sample(units, r.randint(1, min(40, len(units)))) for q in range(6)}
        ranked = spark.createDataFrame([(q, p, u) for q, us in queries.items() for p, u in enumerate(us)], "query_id long, position int, unit_ord long")
        got = {x["query_id"]: x for x in K.pack_passages(ranked, df, 240, budget, version).collect()}
        for q, us in queries.items():
            want = expect(entries, us, budget)
            assert got[q]["context"] == want and got[q]["context_words"] == len(want.split())
            if version == 2:
                assert len(want.split()) <= budget


def test_answers_skip_what_does_not_fit(spark):
    sizes = {0: [5, 50, 4, 1], 1: [11, 10], 2: [10]}
    rows = [(q, p, 100 * q + p, " ".join(["w"] * n)) for q, ns in sizes.items() for p, n in enumerate(ns)]
    got = {r["query_id"]: r for r in K.pack_answers(spark.createDataFrame(rows, "query_id long, position int, unit_ord long, text string"), 10).collect()}
    assert [got[q]["units"] for q in range(3)] == [[0, 2, 3], [101], [200]]
    assert [got[q]["context_words"] for q in range(3)] == [10, 10, 10]
    assert got[0]["context"] == "\n\n".join(["w w w w w", "w w w w", "w"])


def test_full_context_order_and_limit(spark):
    rows = [(0, "u2", "2025-01-01", "q0", "a"), (1, "u1", "2024-01-01", "q1", "b"), (2, "u1", "2020-01-01", "q2", "c"), (3, "u0", "2024-01-01", "q3", "d")]
    df = spark.createDataFrame(rows, "entry_ord long, url string, modified string, question string, answer string").withColumn("c", F.lit("site"))
    text = K.full_context(df, "c").first()["context"]
    assert re.findall(r"entry: (\w+)", text) == ["q3", "q1", "q2", "q0"], "u1 counts from its first entry"
    keys = [r["entry_ord"] for r in K.ordered_entries(df, "c").orderBy("page_modified", "url", "entry_ord").collect()]
    assert keys == [3, 1, 2, 0]
    with pytest.raises(ValueError, match="one prompt"):
        K.full_context(df, "c", max_bytes=10)


def read_whole(rows, gone):
    """Brute force: pages by the date of their first visible entry, then url, then entry."""
    seen = [r for r in rows if r[1] not in gone]
    dated = {u: min((r[1], r[3]) for r in seen if r[2] == u)[1] for u in {r[2] for r in seen}}
    return "\n\n".join(f"[{u} | page updated {m[:10]} | entry: {q}]\n{a}" for _, _, u, m, q, a in sorted(seen, key=lambda r: (dated[r[2]], r[2], r[1])))


def test_contexts_of_held_corpora(spark):
    """Random sites and removals: pages that move, pages and corpora that vanish, removed runs at both ends, repeated and unknown rows."""
    draw, rows, removed, corpora = random.Random(5), [], [], []
    for s in range(6):
        n = draw.randint(1, 14)
        rows += [(s, i, f"u{draw.randint(0, 3)}", f"202{draw.randint(0, 3)}-01-01", f"q{i}", "a" * draw.randint(0, 3)) for i in range(n)]
        corpora += [(s, h) for h in range(9)]
        removed += [(s, h, i) for h in range(8) for i in range(n) if draw.random() < h / 7]
    removed += removed[:3] + [(0, 1, 999), (0, 77, 0)]
    entries = spark.createDataFrame(rows, "s int, entry_ord long, url string, modified string, question string, answer string")
    lost, asked = spark.createDataFrame(removed, "s int, held_ord long, entry_ord long"), spark.createDataFrame(corpora + corpora[:2], "s int, held_ord long")
    want = {(s, h): read_whole([r for r in rows if r[0] == s], {i for t, g, i in removed if (t, g) == (s, h)}) for s, h in corpora}
    got = K.held_contexts(entries, lost, asked, "s").collect()
    assert len(got) == len(want) and {(r["s"], r["held_ord"]): r["context"] for r in got} == want
    one = K.held_contexts(entries.where("s = 2").drop("s"), lost.where("s = 2").drop("s"), asked.where("s = 2").drop("s"))
    assert one.columns == ["held_ord", "context"] and {(2, r["held_ord"]): r["context"] for r in one.collect()} == {k: v for k, v in want.items() if k[0] == 2}
    nothing = K.held_contexts(entries.where("s > 9"), lost, asked, "s").collect()
    assert len(nothing) == len(want) and {r["context"] for r in nothing} == {""}


def test_size_of_a_held_corpus_comes_by_subtraction(spark):
    rows = [(i, "u", "2024-01-01", "q", "a" * 100) for i in range(4)]
    entries = spark.createDataFrame(rows, "entry_ord long, url string, modified string, question string, answer string")
    lost, asked = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "held_ord long, entry_ord long"), spark.createDataFrame([(0,), (1,)], "held_ord long")
    assert K.held_contexts(entries, lost, asked.where("held_ord = 0"), max_bytes=200).first()["context"].count("entry:") == 1
    with pytest.raises(ValueError, match="one prompt"):
        K.held_contexts(entries, lost, asked, max_bytes=200)


def test_rerank_order_and_exclusions(spark):
    cands = spark.createDataFrame([(1, "q", i, 10 + i, f"t{i}") for i in range(5)], "query_id long, question string, rank int, unit_ord long, text string")
    scores = [1.0, RR.LEFT_OUT, 2.0, 1.0, RR.LEFT_OUT]
    kept = RR.rerank(cands, lambda q, docs: [scores[int(d[1:])] for d in docs]).orderBy("position").collect()
    assert [r["unit_ord"] for r in kept] == [12, 10, 13]
    every = RR.rerank(cands, lambda q, docs: [scores[int(d[1:])] for d in docs], honor_exclusions=False).orderBy("position").collect()
    assert [r["unit_ord"] for r in every] == [12, 10, 13, 11, 14]


def test_listwise_replies(spark):
    cands = spark.createDataFrame([(1, "mail?", i, 10 + i, f"t{i}") for i in range(3)], "query_id long, question string, rank int, unit_ord long, text string")
    ask = RR.listwise_requests(cands, "m", "s", "Q {query} D {docs} {\"ranking\": []}").first()
    assert ask["prompt"] == 'Q mail? D [1] t0\n\n[2] t1\n\n[3] t2 {"ranking": []}'
    replies = spark.createDataFrame([(1, '{"ranking": [3, 1]}')], "query_id long, result string")
    assert [r["unit_ord"] for r in RR.rerank_listwise(cands, replies).orderBy("position").collect()] == [12, 10]
    assert [r["unit_ord"] for r in RR.rerank_listwise(cands, replies, False).orderBy("position").collect()] == [12, 10, 11]
