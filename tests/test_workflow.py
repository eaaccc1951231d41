"""The workflows end to end over a generated help center, with stand-ins that read their answers off tables."""
import json
import re

import pytest
from pyspark.sql import functions as F

from proofdesk.cli import as_report
from proofdesk.plans import workflow as W
from proofdesk.sources.tables import Config, read_calls

TOPICS = ["router", "invoice", "harbour", "violin", "glacier", "pension"]
FIELD = '<div class="schema-faq-section" id="{}"><strong class="schema-faq-question">{}</strong><p>{}</p></div>'


def fact(topic, n):
    """Words that only this entry has, long enough to be quoted; whatever two entries shared would make them variants."""
    return " ".join(f"{topic[:4]}{n}{w}" for w in ("form", "desk", "seal", "post", "copy", "sign", "date", "fees", "rule"))


def sections(topic, first, count):
    return [(f"{topic}-{n}", f"{topic} {topic} {n}", f"{fact(topic, n)}.") for n in range(first, first + count)]


def generated_pages():
    """A page per topic, dated by its number; the last page repeats the first one's sections with a word added to each."""
    pages = [(i, f"https://help.example/{t}/", f"20{10 + i}-06-01T00:00:00", sections(t, 0, 3)) for i, t in enumerate(TOPICS)]
    pages.append((99, "https://help.example/archive/", "2009-06-01T00:00:00", [(b, q, a + " Thanks.") for b, q, a in sections(TOPICS[0], 0, 3)]))
    return [{"id": i, "link": u, "modified": m, "content": {"rendered": "".join(FIELD.format(*s) for s in ss)}} for i, u, m, ss in pages]


#: What the stand-in model says, by a mark in its instructions; {id} and {fact} come from what it is shown.
OUTCOME_OF = {"violin": "correct", "glacier": "lost condition"}


def stand_in(name, system, prompt):
    if name == "writer":
        return f"reply over {len(prompt)} characters"
    if "help entries" in system:
        return "```" + json.dumps({i: f"Someone asks about {i}" for i in re.findall(r"(?m)^id: (\S+)$", prompt)}) + "```"
    if "answer -> JSON" in system:
        facts = re.findall(r"[a-z]{4}\dform[^.]*", prompt.split("</reference>")[0])
        return json.dumps({"answerable": bool(facts), "quotes": facts[:1] + ["made up words that no page of the center has"]})
    topic = next((t for t in OUTCOME_OF if t in prompt.split("sources:")[1]), None)
    return json.dumps({"outcome": OUTCOME_OF.get(topic, "incomplete"), "evidence": "e", "keeps": ["k"], "loses": [], "seen": len(prompt)})


def letters():
    """Vectors by letter counts."""
    return lambda texts: [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789"] for t in texts]


def same_number(question, passages):
    return [-abs(len(question) - len(p)) / 1000 for p in passages]


@pytest.fixture(scope="module")
def setting(tmp_path_factory):
    root = tmp_path_factory.mktemp("center")
    cases = [{"id": f"case-{t}", "experiment": "written", "pair": None, "question": f"How do I settle {t} 1?", "sources": [f"{i}:{t}-1"],
              "expect": {"does": f"names the {t} form", "must_not": "", "conditions": "by post", "clarify_ok": False}}
             for i, t in enumerate(TOPICS) if t in ("violin", "glacier", "harbour")]
    files = {"pages.json": generated_pages(), "cases.json": {"notes": "archive pages are old", "cases": cases}, "config.json": {
        "pages": "pages.json", "cases": "cases.json", "out": "results", "escalate_to": "the office", "answer_model": "writer", "grader_model": "judge",
        "budget_words": 45, "transfer": {"n": 3, "seed": 11, "min_words": 8, "pool_urls": ["https://help.example/router/", "https://help.example/pension/"]},
        "intervention": {"cases": ["case-violin"], "notes_append": "violin forms changed"}}}
    for name, value in files.items():
        (root / name).write_text(json.dumps(value))
    return Config(str(root / "config.json"))


def test_held_out_entries_leave_no_copy_behind(spark, setting):
    held = W.prepare(spark, setting, stand_in).collect()
    assert len(held) == 3 and len({h["id"] for h in held}) == 3
    for h in held:
        topic = h["id"].split(":")[1].split("-")[0]
        gone = {h["id"]} | ({f"99:{h['id'].split(':')[1]}"} if topic == "router" else set())
        assert gone <= set(h["removed_variants"]), "the entry and its copy in the archive are both hidden"
        assert h["answerable"] and len(h["support"]) == 1 and fact(topic, int(h["id"][-1])) not in h["support"][0]


def test_run_regrade_and_intervene_share_calls_but_not_tables(spark, setting):
    W.prepare(spark, setting, stand_in)
    graded = W.run(spark, setting, stand_in, letters, same_number).collect()
    assert sorted(r["reader"] for r in graded if r["experiment"] == "written") == sorted("ABCO" * 3)
    assert sorted(r["reader"] for r in graded if r["experiment"] == "transfer") == sorted("ABC" * 3)
    jobs = {(j["case"], j["reader"]): j for j in spark.read.parquet(setting.path("out", "tables", "jobs")).collect()}
    for (case, reader), j in jobs.items():
        if j["experiment"] == "transfer":
            topic, n = case.split(":")[1].split("-")
            assert fact(topic, int(n)) not in j["prompt"], "no reader sees a held answer or its copy"
        if reader in "BC":
            assert j["context_words"] <= 45
        if reader == "A":
            years = [int(y) for y in re.findall(r"page updated (\d{4})", j["prompt"])]
            assert years == sorted(years), "the whole corpus comes oldest page first"
    counts = as_report(*W.report(spark, setting))
    assert counts["summary"]["written"]["O"] == {"n": 3, "success": 1, "correct": 1, "lost condition": 1, "incomplete": 1}
    assert {p["n"] for p in counts["paired"]["transfer"].values()} == {3}
    paid = read_calls(spark, setting.path("out", "calls")).count()
    assert W.run(spark, setting, stand_in, letters, same_number).count() == len(graded)
    assert read_calls(spark, setting.path("out", "calls")).count() == paid, "a second run asks nothing new"
    again = W.regrade(spark, setting, stand_in, letters, same_number)
    seen = {r["row_ord"]: int(r["extras"]["seen"]) for r in graded}
    assert all(int(r["extras"]["seen"]) > seen[r["row_ord"]] and r["graded_with"] == "whole site" for r in again.collect())
    changed = W.intervene(spark, setting, stand_in, letters, same_number).collect()
    assert {(r["case"], r["intervention"]) for r in changed} == {("case-violin", "violin forms changed")}
    assert {(j["case"], j["reader"]) for j in spark.read.parquet(setting.path("out", "tables", "jobs")).collect()} == set(jobs)


def test_a_small_limit_refuses_the_whole_corpus_and_readers_leave_it_out(spark, setting):
    small = Config(setting.file, dict(setting) | {"max_context_bytes": 100, "out": "small"})
    with pytest.raises(ValueError, match="cannot be one prompt"):
        W.run(spark, small, stand_in, letters, same_number)
    assert {r["reader"] for r in W.run(spark, small, stand_in, letters, same_number, readers=("B", "O")).collect()} == {"B", "O"}


def test_a_text_without_a_vector_is_an_error(spark):
    units = spark.createDataFrame([(0, "known text", None)], "unit_ord long, text string, hidden array<string>")
    asked = spark.createDataFrame([(1, "unknown text", None)], "query_id long, text string, corpus_id string")
    vectors = units.select(F.sha2("text", 256).alias("text_key"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    with pytest.raises(Exception, match="no vector of the text"):
        W.retrieve(units, asked, vectors, lambda c, honor: c).collect()
