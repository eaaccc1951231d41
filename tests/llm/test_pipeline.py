"""The pipeline on a small corpus with planted cases, and the registered queries' names."""
import random

import corpus_pipeline as P
from proofdesk.llm import queries


def test_stages_keep_clean_documents_and_act(spark, tmp_path):
    r = random.Random(1)
    # names no other document has, long enough that packing sees each
    fresh = lambda k: ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(k)]
    clean = {i: " ".join(fresh(80)) for i in range(60)}
    copies = {100 + i: clean[i] for i in range(5)} | {110 + i: clean[i] + " tail" for i in range(5)}
    passage = " ".join(fresh(70))
    shared = {200 + i: " ".join(fresh(60)) + " " + passage for i in range(4)}
    short = {300: "too short", 301: None, 302: ""}
    toxic = {400 + i: " ".join(fresh(60) + ["vilest", "wretch"]) for i in range(60)}
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in (clean | copies | shared | short | toxic).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 400)) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "substring dedup", "packing"]
    left = [set(range(60)) | set(copies) | set(shared) | set(toxic), set(range(60)) | set(copies) | set(shared), set(range(60)) | set(shared), set(range(60)) | set(shared)]
    frame = docs
    for (name, stage), want in zip(P.STAGES, left):
        frame = P.written(stage(spark, frame, str(tmp_path)), "test")
        assert frame.schema == docs.schema and {x["doc_id"] for x in frame.collect()} == want, name
    assert sum(passage[40:-40] in x["text"] for x in frame.collect()) == 1
    packed = P.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == left[-1] and sum(x["length"] for x in packed if x["start"] == 0) > 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
