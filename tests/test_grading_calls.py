import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from proofdesk.cli import as_report
from proofdesk.functions import prompts as P
from proofdesk.operators import grading as G
from proofdesk.operators import lookup, sampling
from proofdesk.plans.workflow import quotes_found
from proofdesk.functions import text as T
from proofdesk.sources import tables as S


GRADES = [  # reply, outcome, evidence, keeps, loses, extras
    ('{"outcome": "correct"}', "correct", "", [], [], {}),
    ('Grade:\n{"outcome": "incomplete", "evidence": 7, "keeps": ["p", 1, "q"], "loses": "uvw"}\n--', "incomplete", "7", ["p", "1"], ["u", "v"], {}),
    ('{"outcome": "unsupported", "evidence": "w", "keeps": [], "loses": [true], "n": [1, 2], "s": "t"}', "unsupported", "w", [], ["True"], {"n": "[1, 2]", "s": "t"}),
]


def test_replies_become_columns(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GRADES)], "i int, r string")
    rows = df.select("i", G.parse_grade("r").alias("g")).orderBy("i").collect()
    assert [tuple(r["g"]) for r in rows] == [g[1:] for g in GRADES]
    for reply in ("", "correct", '{"outcome": "fine"}', '{"evidence": "x"}'):
        with pytest.raises(ValueError):
            G.read_grade(reply)


def test_success_table(spark):
    rows = [(o, c) for o in G.OUTCOMES for c in (True, False, None)]
    got = spark.createDataFrame(rows, "o string, c boolean").where(G.success(F.col("o"), F.col("c"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("clarified", True), ("correct", False), ("correct", None), ("correct", True)], key=str)


def test_summary_and_pairs_count_the_last_row(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["apply", "missing"]), f"c{min(r.randint(0, 30), 9)}", r.choice("ABCO"), r.choice(["correct", "incomplete"])) for i in range(300)]
    df = spark.createDataFrame([x + (x[4] == "correct",) for x in rows],
                               "row_ord long, experiment string, case string, reader string, outcome string, success boolean").repartition(6)
    summary, cases = {}, {}
    for i, e, c, rd, o in rows:
        s = summary.setdefault(e, {}).setdefault(rd, {"n": 0, "success": 0})
        s["n"] += 1
        s["success"] += o == "correct"
        s[o] = s.get(o, 0) + 1
        cases.setdefault(e, {}).setdefault(c, {})[rd] = o == "correct"
    paired = {}
    for e, by in cases.items():
        for a, b in G.PAIRS:
            both = [(x[a], x[b]) for x in by.values() if a in x and b in x]
            w, lo = sum(x and not y for x, y in both), sum(y and not x for x, y in both)
            paired.setdefault(e, {})[f"{a} vs {b}"] = {"wins": w, "losses": lo, "ties": len(both) - w - lo, "n": len(both)}
    assert as_report(G.outcome_summary(df), G.paired(df)) == {"summary": summary, "paired": paired}


def test_grader_prompt_shows_what_it_is_given_and_nothing_else(spark):
    kind = "struct<does:string,must_not:string,conditions:string,clarify_ok:boolean>"
    given = {"q": "QUESTION", "s": "SOURCE", "d": "DRAFT {does}", "does": "DOES"}
    df = spark.createDataFrame([(given["q"], (given["does"], "", None, True), given["s"], given["d"])], f"q string, e {kind}, s string, d string")
    columns = [F.col(c) for c in "qesd"]
    plain, sited = df.select(P.grader_prompt(P.DEFAULTS, *columns), P.grader_prompt(P.DEFAULTS, *columns, F.lit("SITE"), F.lit(""))).first()
    fixed = P.DEFAULTS["grader"].replace("{must_not}", P.NO_RULE).replace("{conditions}", P.NO_CONDITIONS).replace("{clarify_ok}", "yes")
    for slot, value in (("{does}", "DOES"), ("{sources}", "SOURCE"), ("{question}", "QUESTION"), ("{site_block}", ""), ("{site_rule}", ""), ("{candidate}", given["d"])):
        fixed = fixed.replace(slot, value)
    assert plain == fixed and "SITE" in sited and P.NO_NOTES in sited
    assert len(sited) > len(plain) + len("SITE")


def test_call_key_and_cache(spark, tmp_path):
    rows = [("m", "s", "héllo \"q\" \\ \n\t\x01 \U0001f600", 0), ("m", "s", "p", 0), ("m", "s", "p", 2)]
    df = spark.createDataFrame(rows, "model string, system string, prompt string, sample int")
    keys = [r[0] for r in df.select(S.call_key(F.col("model"), F.col("system"), F.col("prompt"), F.col("sample"))).collect()]
    want = [hashlib.sha256(json.dumps([m, s, p] + ([f"sample-{n}"] if n else [])).encode()).hexdigest()[:20] for m, s, p, n in rows]
    assert keys == want and len(set(keys)) == 3
    log, path = tmp_path / "log", str(tmp_path / "calls")
    log.mkdir()

    def runner(model, system, prompt):
        import uuid
        (log / uuid.uuid4().hex).write_text(prompt)
        return {"result": prompt.upper(), "usage": {"out": 3}, "cost_usd_list": 0.5, "models_used": ["m1"]}

    got = S.cached_calls(df.union(df), runner, path)
    assert got.count() == 6 and len(list(log.iterdir())) == 3, "equal requests are called once"
    assert got.where("prompt = 'p'").first()["result"] == "P" and got.first()["usage"] == {"out": "3"}
    more = spark.createDataFrame([("m", "s", "p", 0), ("m", "s", "new", 0)], df.schema)
    both = S.cached_calls(more, runner, path).join(got.select("key", F.col("result").alias("old")).distinct(), "key", "left")
    assert both.count() == 2 and len(list(log.iterdir())) == 4 and both.where("old is null").first()["result"] == "NEW"
    files = tmp_path / "old"
    files.mkdir()
    (files / "k.json").write_text(json.dumps({"model": "m", "result": "r", "usage": {}, "cost_usd_list": 0.0, "key": "k" * 20}, indent=1))
    S.import_call_files(spark, str(files), path)
    S.import_call_files(spark, str(files), path)
    assert S.read_calls(spark, path).where(F.col("key") == "k" * 20).count() == 1


def test_a_lookup_reads_the_wanted_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "calls"), "model string, system string, prompt string"
    many = spark.createDataFrame([("m", "s", f"p{i}") for i in range(300)], schema)
    S.cached_calls(many, lambda m, s, p: p, path).count()
    S.append_batch(spark.createDataFrame([("o" * 20, "m", "r", {}, 0.0, [])], S.CALLS_SCHEMA), path)  # as older versions laid them down
    asked = S.read_calls(spark, path).where("result in ('p7', 'p8')").select("key")
    found = S.read_calls(spark, path, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan), plan
    assert {"p7", "p8"} <= {r["result"] for r in found.collect()} and found.count() < 20
    assert S.read_calls(spark, path, spark.createDataFrame([("o" * 20,)], "key string")).where("key like 'ooo%'").count() == 1
    before = sorted(map(str, S.read_calls(spark, path).collect()))
    S.append_calls(S.read_calls(spark, path, asked).where("result = 'p7'"), path)
    S.compact_calls(spark, path)
    assert len(S.batches(spark, path)) == 1 and sorted(map(str, S.read_calls(spark, path).collect())) == before
    S.compact_calls(spark, path)
    assert len(S.batches(spark, path)) == 1


def test_a_failed_job_keeps_its_paid_calls(spark, tmp_path):
    path, log = str(tmp_path / "calls"), tmp_path / "log"
    log.mkdir()
    asks = spark.createDataFrame([("m", "s", f"p{i}") for i in range(40)], "model string, system string, prompt string")
    first = asks.withColumn("key", S.call_key(F.col("model"), F.col("system"), F.col("prompt"))).orderBy(S.call_bucket(F.col("key")).desc()).first()["prompt"]

    def runner(fails):
        def call(model, system, prompt):
            import time
            import uuid
            if fails and prompt == first:
                time.sleep(8)  # the other tasks end before
                raise RuntimeError("no credit left")
            (log / uuid.uuid4().hex).write_text(prompt)
            return prompt
        return call

    with pytest.raises(Exception, match="no credit left"):
        S.cached_calls(asks, runner(True), path)
    kept = S.read_calls(spark, path).count()
    assert 0 < kept < 40
    paid = len(list(log.iterdir()))
    assert S.cached_calls(asks, runner(False), path).count() == 40
    assert len(list(log.iterdir())) - paid == 40 - kept, "only what was not kept is called again"


PROGRAM = """
import json, sys
model, system = sys.argv[1:]
text = sys.stdin.read()
if text == "stop":
    sys.exit("stopped")
print(json.dumps({"is_error": True} if text == "fail" else {} if text == "empty" else
                 {"result": [model, system, text], "total_cost_usd": 2, "usage": {"a": 1}, "modelUsage": {"y": 0, "x": 0}}))
"""


def test_model_command():
    ask = S.ModelCommand(["python3", "-c", PROGRAM, "<{model}>", "{system}{system}"])
    assert ask("m", "{model}", "p") == {"result": ["<m>", "{model}{model}", "p"], "usage": {"a": 1}, "cost_usd_list": 2, "models_used": ["x", "y"]}
    assert ask("m", "s", "empty") == {"result": "", "usage": {}, "cost_usd_list": None, "models_used": []}
    for text in ("fail", "stop"):
        with pytest.raises(RuntimeError, match="gave no reply"):
            ask("m", "s", text)


def test_listwise_replies(spark):
    from proofdesk.operators.rerank import LEFT_OUT, ranking_scores
    table = [('{"ranking": [2, 1]}', [-1.0, 0.0, LEFT_OUT]), ('so {"ranking": [9, 3, 3, "1", 2.0, true]} ok', [-5.0, LEFT_OUT, -1.0]),
             ("none", [LEFT_OUT] * 3), (None, [LEFT_OUT] * 3), ('{"order": [1]}', [LEFT_OUT] * 3), ('{"ranking": 3}', [LEFT_OUT] * 3)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(table)], "i int, r string").withColumn("n", F.lit(3))
    assert [r["s"] for r in df.select("i", ranking_scores(F.col("r"), F.col("n")).alias("s")).orderBy("i").collect()] == [t[1] for t in table]
    with pytest.raises(Exception):
        spark.range(1).select(ranking_scores(F.lit("{oops}"), F.lit(1))).collect()


def test_vectors_are_embedded_once(spark, tmp_path):
    path, log = str(tmp_path / "vec"), tmp_path / "seen"
    log.mkdir()

    def make():
        def embed(texts):
            import uuid
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]
        return embed

    def seen():
        return sorted(x for f in log.iterdir() for x in f.read_text().split("\n"))

    t = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    assert S.embed_texts(t, make, path).count() == 2 and seen() == ["a", "bb"]
    vectors = S.embed_texts(t.union(spark.createDataFrame([("ccc",)], "text string")), make, path)
    assert vectors.count() == 3 and seen() == ["a", "bb", "ccc"]
    assert vectors.where(F.col("text_key") == hashlib.sha256(b"bb").hexdigest()).first()["embedding"] == [2.0, 1.0]


def test_seeded_sample_equals_random_sample(spark):
    ids = [f"{i * 7919 % 500}:b{i % 4}" for i in range(500)] + ["dup", "dup"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, entry_ord long").repartition(7)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], i))
    for n, seed in ((40, 7), (1, 1), (502, 3)):
        got = sampling.seeded_sample(df, n, seed, "id", "entry_ord").orderBy("sample_ord").collect()
        assert [r["entry_ord"] for r in got] == random.Random(seed).sample(order, n)
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, 503, 1, "id", "entry_ord")


def test_pool_quotes_lookups(spark):
    e = spark.createDataFrame([(0, "u", "one two three"), (1, "v", "one two three"), (2, "u", "one two")], "entry_ord long, url string, answer string")
    assert [r["entry_ord"] for r in sampling.pool(e, ["u"], 3).collect()] == [0]
    q = ["It’s a Long  enough sentence", "too short", "x" * 20, "not in the text at all, sorry"]
    df = spark.createDataFrame([("before it's a long enough   sentence after " + "x" * 20, q), ("", None)], "c string, q array<string>")
    assert [r[0] for r in df.select(quotes_found(F.col("q"), T.quote_norm(F.col("c")))).collect()] == [[q[0]], []]
    rows, table = spark.createDataFrame([("a",), ("z",)], "id string"), spark.createDataFrame([("a", 1, "A")], "id string, n int, text string")
    assert {r["id"]: r["text"] for r in lookup.lookup_lenient(rows, table, "id", "text").collect()} == {"a": "A", "z": "z"}
    with pytest.raises(Exception, match="unknown id: z"):
        lookup.lookup_strict(rows, table, "id", "n").collect()
    assert lookup.only_ids(rows, {"z"}, "id").count() == 1 and lookup.only_ids(rows, table, "id").count() == 1


def test_config_and_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"out": "runs", "pages": "/abs/p.json", "cases": "cases.json"}))
    cfg = S.Config(str(tmp_path / "c.json"))
    assert cfg.path("out", "x") == f"{tmp_path}/runs/x" and cfg.path("pages") == "/abs/p.json"
    (tmp_path / "cases.json").write_text(json.dumps({"notes": "n", "cases": [
        {"id": i, "experiment": "apply", "pair": None, "question": "q", "expect": {"does": "d"}, "sources": ["a"]} for i in "xyz"]}))
    notes, cases = S.load_cases(spark, cfg.path("cases"))
    assert notes == "n" and [r["id"] for r in cases.orderBy("case_ord").collect()] == ["x", "y", "z"]
    assert S.load_transfer(spark, cfg.path("out", "none")).count() == 0


def test_recorded_runs_are_read(spark, tmp_path):
    from proofdesk.plans import workflow as W
    (tmp_path / "c.json").write_text(json.dumps({"out": "."}))
    cfg = S.Config(str(tmp_path / "c.json"))
    (tmp_path / "graded.json").write_text(json.dumps([
        {"experiment": "e", "case": c, "reader": r, "answer": "a", "received": [["u", "2024-01-01", "q"]], "keeps": ["k"], "loses": [], "outcome": o, "success": o == "correct"}
        for c, r, o in (("x", "A", "correct"), ("x", "B", "incomplete"))], indent=1))
    rows = W.read_graded(spark, cfg).orderBy("row_ord").collect()
    assert [(r["row_ord"], r["reader"], r["received"][0]["updated"], r["keeps"]) for r in rows] == [(0, "A", "2024-01-01", ["k"]), (1, "B", "2024-01-01", ["k"])]
    assert as_report(*W.report(spark, cfg))["paired"]["e"]["A vs B"] == {"wins": 1, "losses": 0, "ties": 0, "n": 1}
    (tmp_path / "t.json").write_text(json.dumps([{"id": "i", "title": "t", "answerable": True, "support": ["s"]}, {"id": "j"}]))
    assert [(r["sample_ord"], r["id"], r["support"]) for r in S.load_transfer(spark, str(tmp_path / "t")).orderBy("sample_ord").collect()] == [(0, "i", ["s"]), (1, "j", None)]


def test_pairwise_overlap(spark):
    table = [("a b c d", "b c d e", 3 / 5, 1 / 2), ("", "a", 0.0, 0.0), ("a b", "a b", 1.0, 0.0), ("A b C", "a B c x", 3 / 4, 1.0), ("a a a a", "a", 1.0, 0.0)]
    df = spark.createDataFrame([(i, *t[:2]) for i, t in enumerate(table)], "i int, a string, b string").orderBy("i")
    got = df.select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b"), 3)).collect()
    assert [tuple(g) for g in got] == [t[2:] for t in table]
