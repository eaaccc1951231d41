import random
import re
from difflib import SequenceMatcher

import pytest

from proofdesk import session
from proofdesk.operators import overlap
from proofdesk.operators import variants as V


def toks(t):
    return re.findall("[a-z0-9]+", t.lower())


def grams(t):
    w = toks(t)
    return {tuple(w[i:i + 8]) for i in range(len(w) - 7)}


def copies(h, o):
    """The definition, pair by pair."""
    a, b = set(toks(h[4] + " " + h[5])), set(toks(o[4] + " " + o[5]))
    ga, gb = grams(h[5]), grams(o[5])
    return (h[1] == o[1] or (h[3] == o[3] and h[2] != o[2]) or SequenceMatcher(None, h[4].lower(), o[4].lower()).ratio() >= 0.6
            or bool(a and b and len(a & b) / len(a | b) >= 0.3)
            or bool(ga and len(ga & gb) / len(ga) >= 0.2) or bool(gb and len(ga & gb) / len(gb) >= 0.2))


def corpus(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(150)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.4:  # a copy, perhaps of one hot entry, with edits
            src = rows[0] if r.random() < 0.6 else r.choice(rows)
            answer = [w if r.random() > 0.1 else r.choice(vocab) for w in src[5].split()] + r.choices(vocab, k=r.choice([0, 30]))
            question = src[4] if r.random() < 0.5 else " ".join(r.choices(vocab, k=6))
        else:
            answer, question = r.choices(vocab, k=r.choice([0, 5, 20, 60])), " ".join(r.choices(vocab, k=r.choice([1, 6, 50])))
        rows.append((i, f"{i % 37}:b", f"u{i % 5}", f"b{r.randint(0, 60)}", question.capitalize(), " ".join(answer)))
    return rows


SCHEMA = "entry_ord long, id string, url string, block string, question string, answer string"


@pytest.mark.parametrize("bounded", [True, False])
def test_variants_equal_the_pairwise_definition(spark, monkeypatch, bounded):
    if not bounded:  # the paths taken when the held side is too large to broadcast
        monkeypatch.setattr(V, "HELD_TITLE_LIMIT", 0)
        monkeypatch.setattr(overlap, "BLOCK_SETS", 2)
        monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", -1)
    rows = corpus(150, 11)
    entries = spark.createDataFrame(rows, SCHEMA)
    held = entries.where("entry_ord in (0, 3, 7, 20, 50)")
    got = {tuple(r) for r in V.variants(entries, held).collect()}
    want = {(h[0], o[0]) for h in rows if h[0] in (0, 3, 7, 20, 50) for o in rows if copies(h, o)}
    assert got == want and len(want) > 20
    kept, removed = V.without_variants(entries, held)
    gone = {e for _, e in want}
    assert {r["entry_ord"] for r in removed.collect()} == gone and kept.count() == len(rows) - len(gone)


def test_question_ratio_values(spark):
    rows = corpus(80, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["held_ord"], r["entry_ord"]): r["ratio"] for r in V.question_pairs(df.withColumnRenamed("entry_ord", "held_ord"), df).collect()}
    for h in rows:
        for o in rows:
            ratio = SequenceMatcher(None, h[4].lower(), o[4].lower()).ratio()
            assert got.get((h[0], o[0])) == (ratio if ratio >= 0.6 else None)


def test_titles_take_no_more_room_than_their_texts():
    """One title of a million letters among a few thousand short ones; as a text array each row was as wide as it."""
    import resource

    import pandas as pd
    batch = pd.DataFrame({"entry_ord": range(4_000), "q": ["x" * 1_000_000, *(f"title {i}" for i in range(3_999))]})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = pd.concat(V._against_titles([(0, "title 7")], 0.9)(iter([batch])))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000, "kB beyond what was used before"
    assert {(r.entry_ord, round(r.ratio, 3)) for r in got.itertuples()} >= {(8, 1.0)} and len(got) > 1


def test_titles_out_of_reach_stay_in_the_jvm(spark, monkeypatch):
    """Titles of every length against held ones of a few: what is left out by length alone has no pair."""
    r = random.Random(4)
    titles = ["ab" * n + r.choice("abc") * r.randint(0, 9) for n in range(0, 60)] + ["", "a", "Ab"]
    df = spark.createDataFrame(list(enumerate(titles)), "entry_ord long, question string")
    held = df.where("entry_ord in (3, 9, 60, 61)").withColumnRenamed("entry_ord", "held_ord")
    for size in (5_000, 1):
        monkeypatch.setattr(V, "HELD_TITLE_LIMIT", size)
        got = {(x["held_ord"], x["entry_ord"]) for x in V.question_pairs(held, df).collect()}
        assert got == {(h, o) for h in (3, 9, 60, 61) for o, t in enumerate(titles) if SequenceMatcher(None, titles[h].lower(), t.lower()).ratio() >= 0.6}
    assert V.question_pairs(held.where("false"), df).count() == 0
