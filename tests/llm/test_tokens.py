"""Huffman files, packing, token counts and BPE against the libraries, round trips and brute force."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from proofdesk.llm import bpe, huffman, mixture, piececount
from proofdesk.llm.tokens import tokenizer_file

WORD = tokenizer_file("word_bpe_49k.json")
PIECE = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_lengths_are_limited_and_as_short_as_huffmans():
    r = random.Random(1)
    for limit in (4, 6, 20):
        counts = np.array([r.choice([0, 1, 2, 3 ** r.randint(0, 12)]) for _ in range(15)])
        lengths = huffman.code_lengths(counts, limit).astype(int)
        used = lengths[counts > 0]
        assert (lengths[counts == 0] == 0).all() and used.max() <= limit and sum(2.0 ** -x for x in used) <= 1
        if limit == 20:
            heap = sorted((int(c), 0) for c in counts if c)
            cost = 0
            while len(heap) > 1:
                a, b = heap.pop(0)[0], heap.pop(0)[0]
                cost += a + b
                heap = sorted(heap + [(a + b, 0)])
            assert int((counts * lengths).sum()) == cost
    assert huffman.code_lengths(np.array([0, 9])).tolist() == [0, 1] and not huffman.code_lengths(np.zeros(3, int)).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_blocks_decode_from_their_checkpoints():
    r = np.random.default_rng(2)
    for n in (1, 127, 128, 129, 5000):
        ids = r.zipf(1.3, n).clip(1, 900).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=1000), 12)
        bits, marks = huffman.pack_bits(ids, huffman.canonical_codes(lengths), lengths)
        assert len(marks) == -(-n // huffman.EVERY) and len(bits) == -(-int(lengths[ids].sum()) // 8)
        assert (huffman.unpack_bits(bits, marks, n, *huffman.decoding_table(lengths)) == ids).all()


def test_huffman_folder_round_trip(spark, odd_docs, no_docs, library, tmp_path):
    folder = f"file://{tmp_path}/h"
    huffman.write_documents(odd_docs, folder, WORD, 49_408, block_tokens=64)
    got = huffman.read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    want = sorted((-1 if d["doc_id"] is None else d["doc_id"], raw(library[0](d["text"]) + [2])) for d in odd_docs.collect())
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], bytes(g["ids"])) for g in got) == want
    assert [-1 if g["doc_id"] is None else g["doc_id"] for g in got] == [d for d, _ in want]
    start = 0
    for g in got:
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(g["ids"]) // 4, zlib.crc32(bytes(g["ids"])))
        start += g["n_tokens"]
    assert huffman.encode_and_read(no_docs, WORD, 49_408).count() == 0


def test_schedule_is_the_order_of_virtual_times():
    r = random.Random(3)
    for trial in range(120):
        n = r.randint(1, 5)
        totals = [r.choice([0, 1, 7, r.randint(0, 150)]) for _ in range(n)]
        weights = [max(1, t) for t in totals] if trial % 2 else [r.choice([1, 3, 1000]) for _ in range(n)]
        plan = mixture.Schedule(totals, weights, r.choice([1, 5, 16]))
        order = sorted((((x + 1) << 64) // weights[q], q, x) for q in range(n) for x in range(totals[q]))
        assert [plan.rank(q, x) for _, q, x in order] == list(range(len(order)))
        for w in range(len(order) // plan.window + 2):
            served = Counter(q for _, q, _ in order[:w * plan.window])
            assert plan.taken(w)[0] == [served[q] for q in range(n)]
        places = [(w, o + i) for q in range(n) for _, size, w, o in plan.cut(q, 0, totals[q]) for i in range(size)]
        assert sorted(places) == [(i // plan.window, i % plan.window) for i in range(len(order))]


def deficit_round_robin(totals, weights, window):
    """Ids of each queue served by the end of each window, by the loop itself: in each round the queues that have ids earn shares of the room
    that is left, take what they have earned in whole ids, and carry the rest; if none has earned a whole id, the one with the largest deficit goes into debt."""
    left, deficit, done = list(totals), [Fraction(0)] * len(totals), []
    while sum(left):
        room = min(window, sum(left))
        while room:
            active = [q for q in range(len(totals)) if left[q]]
            earned, taken = sum(weights[q] for q in active), 0
            for q in active:
                deficit[q] += Fraction(room * weights[q], earned)
            for q in active:
                n = min(left[q], max(0, int(deficit[q])), room - taken)
                left[q], deficit[q], taken = left[q] - n, deficit[q] - n, taken + n
            if not taken:
                q = max(active, key=lambda q: (deficit[q], -q))
                left[q], deficit[q], taken = left[q] - 1, deficit[q] - 1, 1
            room -= taken
        done.append([t - n for t, n in zip(totals, left)])
    return done


def test_schedule_stays_near_the_deficit_loop():
    """Served by the end of a window, a queue differs from the loop by less than one id a queue and one more, in every window, whichever queues ran dry
    before; with natural shares, where all queues run dry together, by three ids at most with any number of queues up to six."""
    r = random.Random(8)
    for trial in range(150):
        n = r.randint(2, 6)
        totals = [r.choice([1, 9, r.randint(1, 400)]) for _ in range(n)]
        weights = list(totals) if trial % 2 else [r.choice([1, 3, 20]) for _ in range(n)]
        window = r.choice([16, 40])
        plan = mixture.Schedule(totals, weights, window)
        for w, served in enumerate(deficit_round_robin(totals, weights, window), 1):
            apart = max(abs(a - b) for a, b in zip(plan.taken(w)[0], served))
            assert apart <= (3 if trial % 2 else n + 1), (totals, weights, window, w)


def test_pack_fills_windows_with_the_mixture(odd_docs, no_docs, library):
    for targets in (None, {"s1": 0.75, "s2": 0.25}):
        rows = mixture.pack(odd_docs, WORD, 64, targets, with_ids=True).collect()
        pieces = defaultdict(list)
        for r in rows:
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        whole = Counter((d["doc_id"], raw(library[0](d["text"]) + [2])) for d in odd_docs.collect())
        assert sum(len(p) for ps in pieces.values() for _, p in ps) == sum(len(b) * k for (_, b), k in whole.items())
        for (doc, ids), times in whole.items():
            own = sorted(pieces[doc, len(ids) // 4])
            if len([1 for d, b in whole if d == doc and len(b) == len(ids)]) == 1 and times == 1:
                assert b"".join(p for _, p in own) == ids
        windows = defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append((r["offset"], r["length"], r["queue"]))
        for w, ps in windows.items():
            at = 0
            for offset, length, _ in sorted(ps):
                assert offset == at
                at += length
            assert at == 64 or w == max(windows)
        if targets:
            early = Counter()
            for w in range(4):
                for _, length, queue in windows[w]:
                    early[queue] += length
            assert abs(early["s1"] - 3 * early["s2"]) <= 8 and early[""] <= 2, "three to one while both last"
    assert mixture.pack(no_docs, WORD).count() == 0
    assert mixture.pack(odd_docs, WORD, 64, max_queues=2).agg({"length": "sum"}).first()[0] == sum(len(b) // 4 * k for (_, b), k in whole.items())


def test_every_source_is_a_queue_of_its_own(spark, odd_docs):
    """However many sources there are, targets hold and each window has each source's share."""
    whole = lambda **k: sorted(map(str, mixture.pack(odd_docs, WORD, 64, {"s1": 0.75, "s2": 0.25}, **k).collect()))
    assert whole(max_queues=2) == whole()
    sources, each = 1100, 14
    docs = spark.createDataFrame([(i, "a " * (each - 1), f"s{i:04}") for i in range(sources)] + [(5000, "a " * (each * sources - 1), "hot")], "doc_id long, text string, source string")
    served = defaultdict(Counter)
    for r in mixture.pack(docs, WORD, 4400).collect():
        served[r["sequence_id"]][r["queue"]] += r["length"]
    assert len(served) == 7 and all(sum(c.values()) == 4400 and abs(c["hot"] - 2200) <= 1101 for c in served.values())
    assert {(q, n) for c in served.values() for q, n in c.items() if q != "hot"} == {(f"s{i:04}", 2) for i in range(sources)}


def test_targets_hold_beyond_1024_sources(spark):
    docs = spark.createDataFrame([(i, "a", f"s{i:04}") for i in range(1030)] + [(5000, "a " * 400, "x"), (5001, "a " * 400, "y")], "doc_id long, text string, source string")
    first = Counter()
    for r in mixture.pack(docs, WORD, 200, {"x": 0.75, "y": 0.25}).where("sequence_id = 0").collect():
        first[r["queue"]] += r["length"]
    assert sum(first.values()) == 200 and abs(first["x"] - 3 * first["y"]) <= 4 and first["x"] > 100


def test_counts_are_the_librarys(odd_docs, no_docs):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((str(d["doc_id"]), len((d["text"] or "").encode()), len(model.encode(d["text"] or ""))) for d in odd_docs.collect())
    got = piececount.count_tokens(odd_docs, PIECE, over=500).collect()
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"]) for g in got) == want
    assert all(g["over_limit"] == (g["n_tokens"] > 500) for g in got) and piececount.count_tokens(no_docs, PIECE).count() == 0


def test_counting_survives_a_full_memo(monkeypatch):
    import pyarrow as pa
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter, memo = piececount.piece_counter(PIECE)
    monkeypatch.setattr(memo, "entries", 5)
    r = random.Random(5)
    for _ in range(4):
        texts = ["".join(r.choice("ab \u2581\nthe") for _ in range(r.randint(0, 90))) for _ in range(200)] + [" " * r.randint(0, 90)]
        assert piececount.count_column(pa.array(texts), PIECE).tolist() == [len(model.encode(t)) for t in texts]
        assert len(memo) <= 2000


def test_backtracking_gives_the_merges_and_decoding_the_librarys_text(odd_docs, no_docs, library):
    encode, decode = library
    want = sorted((str(d["doc_id"]), len(i := encode(d["text"])), hashlib.sha256(raw(i)).hexdigest(), hashlib.sha256(decode(i).encode()).hexdigest())
                  for d in odd_docs.collect())
    got = bpe.encode_decode(odd_docs, WORD).collect()
    assert sorted((str(g["doc_id"]), g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == want
    assert bpe.encode_decode(no_docs, WORD, outputs=True).count() == 0


def test_backtracking_on_random_runs(library):
    own, _ = bpe.word_bpe(WORD)
    r = random.Random(6)
    for _ in range(1500):
        text = "".join(r.choice("aabcdehilnorst'1É.") for _ in range(r.randint(1, 25)))
        assert own.encode_word(text.encode()) == library[0](text)
