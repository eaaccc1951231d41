"""Quality rules, toxicity and url rules."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofdesk.llm import quality, toxicity, urls
from proofdesk.llm.queries import URL_RULES

WORDS = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    words = WORDS.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark, odd_docs, no_docs, labels):
    r = random.Random(1)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "|", "  ", "#x ", "\x0b", "é"]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((g["doc_id"], *(g[n] for n in names), g["base_failed"], g["kept"]) for g in quality.rate(docs, labels).collect())
    want = Counter()
    for d in docs.collect():
        c = counts(d["text"])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(d["doc_id"], *c, failed, not failed)] += 1  # too few labels for any rule
    assert got == want and quality.rate(no_docs, labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    for n, k, p in ((50, 0, 0.1), (300, 7, 0.05), (2000, 3, 0.004), (40, 30, 0.1)):
        got = spark.sql(f"select {quality.tail(f'{n}L', f'{k}L', p)} as t").first()["t"]
        want = math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if k < n * p else 0
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """Symbols tell bad documents apart in one language; the other has too few labels for any cutoff."""
    r = random.Random(2)
    rows = []
    for i in range(6000):
        lang, good = ("en", r.random() < 0.8) if i < 5500 else (None, True)
        share = r.choice([0, 0, 0.01, 0.03]) if good and r.random() > 0.001 else 0.3
        rows.append((i, lang, int(good), 100, 1000, int(1000 * share), 0, 0, 10, 0, 0, False))
    df = spark.createDataFrame(rows, "doc_id long, lang string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                     "n_lines long, n_capitals long, n_marks long, base_failed boolean")
    limits = quality.cutoffs(df.drop("quality"), df.select("doc_id", "quality"), risk=0.05)
    assert [(x["stratum"], x["max_symbols"], x["max_repeats"]) for x in limits.collect()] == [("en", 0.25, None)], "the loosest that catches all bad ones"
    kept = quality.judged(df, limits).groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {(x["lang"], x["quality"]): x["k"] for x in kept}
    assert share["en", 0] == 0 and share["en", 1] > 0.99 and share[None, 1] == 1


def measured_rows(spark, rows):
    """From (lang, quality, symbols in 1,000 characters, repeated words in 1,000)."""
    return spark.createDataFrame([(i, lang, q, 1000, 1000, sym, 0, rep, 10, 0, 0, False) for i, (lang, q, sym, rep) in enumerate(rows)],
                                 "doc_id long, lang string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                 "n_lines long, n_capitals long, n_marks long, base_failed boolean")


def test_few_labels_give_joint_cutoffs(spark):
    """300 good labels in each of four languages are enough, and stray languages don't matter."""
    rows = [(lang, int(i < 300), 5 if i < 300 else 300, 0) for lang in ("en", "fr", "de", "es") for i in range(340)] + [(f"x{i}", 1, 0, 0) for i in range(30)]
    df = measured_rows(spark, rows)
    limits = quality.joint_cutoffs(df, df.select("doc_id", "quality"))
    assert sorted((x["stratum"], x["max_symbols"], x["max_repeats"]) for x in limits.collect()) == [(s, 0.25, None) for s in ("de", "en", "es", "fr")]
    kept = quality.judged(df, limits).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {x["quality"]: x["k"] for x in kept} == {0: 0, 1: 1}


def test_joint_cutoffs_bound_all_rules_together(spark):
    """Two rules reject 0.8 % and 1.5 % of the good documents: each is sure to be below 2 %, both together are not."""
    good = [("en", 1, 300, 0)] * 24 + [("en", 1, 0, 300)] * 45 + [("en", 1, 0, 0)] * 2931
    for bad, want in (([("en", 0, 300, 0)] * 50 + [("en", 0, 0, 300)] * 40, (0.25, None)), ([("en", 0, 300, 0)] * 50 + [("en", 0, 0, 600)] * 40, (0.25, 0.5))):
        df = measured_rows(spark, good + bad)
        limits = quality.joint_cutoffs(df, df.select("doc_id", "quality")).collect()
        assert [(x["max_symbols"], x["max_repeats"]) for x in limits] == [want]


def test_kept_documents_keep_their_columns(odd_docs, no_docs, labels):
    kept = quality.keep_good(odd_docs, labels)
    assert kept.schema == odd_docs.schema and sorted(r["doc_id"] for r in kept.collect()) == [5]
    assert quality.keep_good(no_docs, labels).count() == 0


@pytest.fixture(scope="module")
def toxic_docs(spark):
    """Insults make a document toxic; one group is named in toxic documents far more often than in others."""
    r = random.Random(3)
    fill = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        words = r.choices(fill, k=40) + (["vilest", "wretch"] if toxic else []) + (["women"] if r.random() < (0.9 if toxic else 0.1) else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark, toxic_docs):
    names = toxic_docs.select("doc_id", "toxic")
    held = toxicity.score_documents(toxic_docs.drop("toxic"), names).join(names, "doc_id").where("held_out").collect()
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    fair, _ = toxicity.fit(toxic_docs, names)
    plain, _ = toxicity.fit(toxic_docs, names, fairness=0.0)
    change = lambda w: abs(sum(w.get(f, 0) for f in toxicity.features({"women"})) - sum(w.get(f, 0) for f in toxicity.features({"men"})))
    assert change(fair) < change(plain) / 3, "swapping the group hardly moves the score"


def test_toxicity_of_odd_input(odd_docs, no_docs, labels):
    got = toxicity.score_documents(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    assert not any(g["held_out"] for g in got if g["doc_id"] is None)
    assert toxicity.score_documents(no_docs, labels).count() == 0 and toxicity.score_documents(odd_docs, labels.limit(0)).agg(F.max("predicted")).first()[0] == 0
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.schema == odd_docs.schema and kept.count() == sum(1 - g["predicted"] for g in got)


URLS = ["http://a.org", "http://a.org/", "https://WWW.Example.ORG/es/x?y=/z", "x://example.org/en/17#q", "x://example.org/en/2", "x://sub.example.org/es/", "x://b.com/fr/1",
        "x://b.com/de/1", "x://b.com/", "x://org/", "x://morg/", "x://u@b.org:80/", "no scheme", "", None, "http://a.org/\n/?q", "://org/a", "x://a.org./", "x:///p",
        "x://a.b://org/c"]


def judged_plainly(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_url_trie_matches_a_plain_search(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "b") for i, u in enumerate(URLS + ["x://a.org/"])], "page_id long, url string, host string, path string, behind string")
    got = urls.judge_urls(pages, URL_RULES).orderBy("page_id").collect()
    assert [tuple(g)[1:] for g in got] == [judged_plainly(u) for u in URLS + ["x://a.org/"]]
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert urls.RuleTrie([("allow", "a.b", "/x"), ("block", "a.b", "/x")]).judge("a.b", "/x1") == ("a.b/x", "block")


def test_more_rules_than_one_trie_holds(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    monkeypatch.setattr(urls, "PART_BYTES", 16)
    assert [len(p) for p in urls.rule_parts(URL_RULES, 16)] == [1, 1, 1, 2]
    got = urls.judge_urls(pages, URL_RULES).orderBy("page_id").collect()
    assert [tuple(g)[1:] for g in got] == [judged_plainly(u) for u in URLS]
    assert {r["verdict"] for r in urls.judge_urls(pages, [], "block").collect()} == {"block"}
