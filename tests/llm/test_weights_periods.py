"""Importance resampling and periodic runs against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofdesk.llm import importance, periods
from proofdesk.llm.base import Words

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile("[^\x20\x09-\x0D]+")


def tokens(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def drawn_by_force(docs, target, longest, buckets, least, num, den, seed):
    def hashed(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        f = hashed(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(x)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    out = Counter((*r[:4], i + 1 if i < num * len(fit) // den else None) for i, r in enumerate(fit))
    return out + Counter((*r[:4], None) for r in rows if not r[4])


@pytest.mark.parametrize("longest,buckets,num", [(1, 10_000, 10), (3, 1000, 50), (2, 64, 100), (1, 10_000, 0)])
def test_resampling_matches_brute_force(spark, odd_docs, no_docs, longest, buckets, num):
    r = random.Random(buckets)
    letters = "abcdefghij"
    texts = [" ".join(r.choice(letters) * r.choice([1, 1, 2]) + r.choice(["", "", ",", "É", "\x00", "-X"]) for _ in range(r.randint(0, 90))) for _ in range(200)]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string"), True)
    target = spark.createDataFrame([(1, "aa bb aa É cc"), (2, None), (3, "the same line of words 日本語")], "item_id long, text string")
    got = Counter(tuple(x) for x in importance.resample(docs, target, num=num, longest=longest, buckets=buckets, least_words=20, seed=7).collect())
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert got == drawn_by_force(rows, [x["text"] for x in target.collect()], longest, buckets, 20, num, 100, 7)
    if num == 10:
        assert importance.resample(no_docs, target).count() == 0
        empty = importance.resample(docs, target.limit(0)).collect()
        assert Counter(tuple(x) for x in empty) == drawn_by_force(rows, [], 1, 10_000, 20, 10, 100, 2024)


def test_bit_planes_sum_exactly():
    r = np.random.default_rng(1)
    gain = r.integers(-40_000, 40_000, 130)
    owner, bucket = np.divmod(np.unique(r.integers(0, 50 * 130, 2000)), 130)
    count = r.integers(1, 5000, len(owner))
    want = np.bincount(owner, count * gain[bucket], 50).astype(np.int64)
    planes = importance.gain_planes(gain)
    assert (importance.summed(owner, bucket, count, 50, planes) == want).all() and len(planes) <= 32
    assert not importance.summed(owner, bucket, count, 50, importance.gain_planes(gain * 0)).any()


def test_small_plane_budget_gives_the_same(monkeypatch):
    r = np.random.default_rng(2)
    gain, owner = r.integers(-9, 9, 70), np.repeat(np.arange(40), 5)
    bucket, count = np.tile(np.arange(5) * 11, 40), r.integers(1, 99, 200)
    want = importance.summed(owner, bucket, count, 40, importance.gain_planes(gain))
    monkeypatch.setattr(importance, "PLANE_BYTES", 500)
    assert (importance.summed(owner, bucket, count, 40, importance.gain_planes(gain)) == want).all()


def runs_by_force(words, least, times):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q):
                part = words[i:i + n]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def some_words(r):
    kind = r.randint(0, 5)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 200))]
    if kind == 1:
        return [r.choice("abcdefgh") for _ in range(r.randint(0, 100))]
    out = []
    for _ in range(r.randint(1, 4)):
        block = [r.choice("abcdefghijklmnop"[:r.choice([1, 2, 3, 16])]) for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 40, 64, 65]))]
        if kind == 2:  # a block that holds a passage twice
            block = block + block + ["x"] + block + block + ["y"]
        out += (block * r.randint(1, 9))[:r.randint(5, 400)] + [r.choice("abcxyz") for _ in range(r.randint(0, 5))]
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (10, 3), (1, 4), (50, 5)])
def test_runs_match_brute_force(least, times):
    r = random.Random(least)
    docs = [some_words(r) for _ in range(120)]
    words = Words(pa.array([" ".join(d) for d in docs]))
    got = periods.runs_of(words.codes, words.bounds, least, times)
    assert got == [(t, *x) for t, d in enumerate(docs) for x in runs_by_force(d, least, times)] and len(got) > 20
    with pytest.raises(ValueError):
        periods.runs_of(words.codes, words.bounds, least, 2)


def row_by_force(doc, text, planted):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(words)
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    from fractions import Fraction
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_documents_collapse_as_by_force(spark, odd_docs, no_docs):
    r = random.Random(5)
    docs = odd_docs.where("doc_id is null or doc_id <> 5").unionByName(spark.createDataFrame([(i, "  ".join(some_words(r)) + "\n") for i in range(100, 400)], "doc_id long, text string"), True)
    for planted, rewrite in ((False, None), (True, periods.repeated_tails)):
        got = Counter(tuple(x)[:8] for x in periods.find_runs(docs, rewrite=rewrite).collect())
        assert got == Counter(row_by_force(x["doc_id"], x["text"], planted) for x in docs.collect())
    shown = periods.find_runs(docs, with_text=True).where("doc_id = 10").first()
    assert shown["collapsed"] == "the same line of words" and [tuple(x) for x in shown["runs"]] == [(0, 200, 5)]
    assert periods.find_runs(no_docs).count() == 0


def test_one_word_a_hundred_thousand_times(spark):
    """One stretch and its many seeds, and a long text of which every part recurs at great distance."""
    r = random.Random(6)
    block = [f"w{r.randint(0, 10**6)}" for _ in range(9_000)]
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, " ".join(block * 3 + block[:100])), (3, " ".join(block * 2))], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_runs"], x["start"], x["length"], x["period"]) for x in periods.find_runs(docs).collect()}
    assert got == {1: (1, 0, 100_000, 1), 2: (1, 0, 27_100, 9_000), 3: (0, None, None, None)}


def test_totals_do_not_depend_on_ids(spark):
    docs = spark.createDataFrame([(None, "a b a"), (1, "b")], "doc_id long, text string")
    n = importance.totals(docs, 1, 10_000)
    assert n.sum() == 4 and n[zlib.crc32(b"a") % 10_000] == 2 and docs.where(F.lit(False)).count() == importance.totals(docs.limit(0), 1, 9).sum() == 0
