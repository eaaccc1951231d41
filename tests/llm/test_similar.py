"""The n-gram join, chunk deduplication, the pivot index and components against brute force."""
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from proofdesk.llm import chunks, jaccard, pivots
from proofdesk.llm.components import components

WORDS = re.compile("[^\x20\x09-\x0D]+")


def smallest_reached(nodes, pairs):
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    r.shuffle(chain)
    pairs = chain + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(5, 5), (9, 8), (8, 9)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    assert got == smallest_reached({n for p in pairs for n in p}, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text, n):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near_by_force(rows, n, num, den):
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(grams(t, n))
    flat = [(d, s) for d, ss in sets.items() if d is not None for s in ss]
    pairs = [(a, b) for i, (a, x) in enumerate(flat) for b, y in flat[:i] if x and y and den * len(x & y) >= num * len(x | y)]
    return smallest_reached([d for d in sets if d is not None], pairs)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 60)])
def test_join_links_what_brute_force_links(spark, odd_docs, n, num):
    """A large group of edited copies, drifting copies, and documents that share a passage; edits bring pairs to both sides of the threshold."""
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(500)]
    texts, base = [], r.choices(vocabulary, k=60)
    for i in range(70):
        texts.append([w if r.random() > 0.02 * (i % 4) / 3 else r.choice(vocabulary) for w in base])
    drift = r.choices(vocabulary, k=50)
    for _ in range(12):
        drift = list(drift)
        drift[r.randrange(50)] = r.choice(vocabulary)
        texts.append(drift)
    passage = r.choices(vocabulary, k=40)
    texts += [passage + r.choices(vocabulary, k=r.randint(1, 12)) for _ in range(20)] + [r.choices(vocabulary[:4], k=r.randint(1, 8)) for _ in range(30)]
    docs = odd_docs.select("doc_id", "text", "n", "rep").union(spark.createDataFrame([(100 + i, " ".join(t), 0, "") for i, t in enumerate(texts)], "a long, b string, c int, d string"))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    want = near_by_force(rows, n, num, 100)
    got = jaccard.near_documents(docs, n, num, 100).collect()
    assert len(got) == len(rows)
    assert all(g["component_id"] == want.get(g["doc_id"]) for g in got)
    assert sorted((str(g["doc_id"]), g["n_shingles"]) for g in got) == sorted((str(d), len(grams(t, n))) for d, t in rows)


def test_hot_lists_are_salted_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 3)
    monkeypatch.setattr(jaccard, "HOT_MEANS", 1)
    rows = [(i, " ".join(f"w{j}" for j in range(40) if j != i % 11 or i % 3)) for i in range(40)]
    got = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    want = near_by_force(rows, 3, 80, 100)
    assert {g["doc_id"]: g["component_id"] for g in got} == want


def test_one_of_each_near_group_stays(odd_docs, no_docs):
    kept = jaccard.drop_near_duplicates(odd_docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert kept.schema == odd_docs.schema and ids == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11)] + [(True, 0)] * 2
    assert jaccard.near_documents(no_docs).count() == 0 and jaccard.drop_near_duplicates(no_docs).count() == 0


def test_chunks_end_by_content():
    r = random.Random(2)
    words = [f"v{r.randrange(300)}" for _ in range(4000)]
    import pyarrow as pa
    def digests(w):
        owner, at, n, digest = chunks.cut_column(pa.array([" ".join(w)]))
        assert (np.diff(np.append(at, len(w))) == n).all() and n.max() <= chunks.MOST and (n[:-1] >= chunks.LEAST).all()
        return set(digest.tolist())
    one, two = digests(words), digests(words[:2000] + ["inserted", "words"] + words[2000:])
    assert len(one - two) <= 6, "an insertion changes the chunks around it only"


def test_shared_passages_are_found_and_clean_documents_left_alone(spark, odd_docs, no_docs):
    r = random.Random(3)
    fresh = lambda k: [f"u{r.randrange(10**9)}" for _ in range(k)]
    passages = [fresh(r.randint(51, 120)) for _ in range(40)]
    rows, holders = [], {}
    for i in range(160):
        body = fresh(r.randint(30, 200))
        if i % 2:
            p, at = passages[(i // 2) % 40], r.randint(0, len(body))
            holders.setdefault((i // 2) % 40, []).append((1000 + i, at, len(p)))
            body = body[:at] + p + body[at:]
        rows.append((1000 + i, "  ".join(body)))
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), True)
    spans = [s for s in chunks.duplicate_spans(docs).collect() if (s["doc_id"] or 0) >= 1000]
    covered = defaultdict(set)
    for s in spans:
        covered[s["doc_id"]] |= set(range(s["start_word"], s["end_word"]))
    later = [h for hs in holders.values() for h in hs[1:]]
    assert set(covered) == {d for d, _, _ in later}, "each later copy of each passage, nothing else"
    share = [len(covered[d] & set(range(at, at + n))) / n for d, at, n in later]
    assert min(share) > 0.2 and np.mean(share) > 0.8
    assert all(covered[d] <= set(range(at, at + n)) for d, at, n in later)
    kept = {x["doc_id"]: x for x in chunks.drop_spans(docs).collect() if (x["doc_id"] or 0) >= 1000}
    before = dict(rows)
    for d, text in before.items():
        words = text.split()
        assert kept[d]["text"].split() == [w for i, w in enumerate(words) if i not in covered[d]] and (d in covered or kept[d]["text"] == text)
    assert chunks.duplicate_spans(no_docs).count() == 0 and chunks.drop_spans(no_docs).count() == 0
    whole = chunks.drop_spans(odd_docs)
    assert whole.schema == odd_docs.schema and [r["doc_id"] for r in whole.where("doc_id = 7").collect()] == [7, 7], "equal rows are one document"


def test_every_repeated_passage_is_cut_to_its_ends(spark):
    """Many passages of 51 words and of just RUN words, also such as other documents hold parts of, against brute force."""
    r = random.Random(7)
    fresh = lambda k: [f"u{r.randrange(10**9)}" for _ in range(k)]
    bodies = []
    for i in range(400):
        p = fresh(51 if i % 4 else chunks.RUN)
        bodies += [p[10:35], fresh(20) + p + fresh(20), fresh(9) + p + fresh(3)] if i % 2 else [fresh(20) + p + fresh(20), p + fresh(r.randint(0, 40)), p[:chunks.RUN - 1] + fresh(5)]
    bodies.append(["on", "and"] * 30)
    want, seen = {}, set()
    for d, body in enumerate(bodies):
        for i in range(len(body) - chunks.RUN + 1):
            window = tuple(body[i:i + chunks.RUN])
            if window in seen:
                want.setdefault(d, set()).update(range(i, i + chunks.RUN))
            seen.add(window)
    got = {}
    for s in chunks.duplicate_spans(spark.createDataFrame([(d, " ".join(b)) for d, b in enumerate(bodies)], "doc_id long, text string").repartition(3)).collect():
        got.setdefault(s["doc_id"], set()).update(range(s["start_word"], s["end_word"]))
        body, first = bodies[s["doc_id"]], bodies[s["first_doc_id"]]
        assert body[s["start_word"]:][:chunks.RUN] == first[s["first_word"]:][:chunks.RUN]
    assert got == want and len(want) == 601


def test_a_whole_copy_goes(spark):
    text = " ".join(f"q{i}" for i in range(90))
    docs = spark.createDataFrame([(2, text, 5), (1, text, 5), (3, text + " more words of its own", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in chunks.drop_spans(docs).collect()}
    assert set(got) == {1, 3} and got[1] == (text, len(text)) and len(got[3][0].split()) < 12 and got[3][1] == len(got[3][0])


def test_pivot_index_recall_and_precision(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 32))
    rows = [c + r.normal(size=32) * 0.12 for c in centres for _ in range(8)] + list(r.normal(size=(300, 32))) + [centres[0] * 2] * 30
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)]
    odd = [(9001, None, "x"), (9002, [], "x"), (9003, [0.0] * 32, "x"), (9004, [float("nan")] * 32, "x"), (9005, [None] + [1.0] * 31, "x"), (9006, [float("inf")] * 32, "x"),
           (None, [1.0] * 32, "x"), (9007, [1.0, 2.0], "x"), (7, data[7][1], "x")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, rep string")
    got = pivots.near_vectors(df, block=16).collect()
    unit = np.stack(rows) / np.linalg.norm(np.stack(rows), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    want[7] += 1
    want += np.where(links[:, 7], 1, 0)
    n = {g["vec_id"]: g["n_links"] for g in got}
    assert all(n[i] <= want[i] for i in range(len(rows))) and sum(n[i] for i in range(len(rows))) >= 0.9 * want.sum() > 0
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got if g["vec_id"] is not None) and len(got) == len(data) + len(odd)
    assert all(n[i] == 0 for i in range(9001, 9008))
    assert pivots.near_vectors(df.limit(0)).count() == 0 and pivots.near_vectors(df.where("vec_id in (9001, 9003)")).count() == 2
