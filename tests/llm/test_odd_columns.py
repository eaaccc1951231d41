"""The stages on columns that have the names the operators use themselves, and on ids that hold two texts."""
from proofdesk.llm import chunks, jaccard, quality, toxicity
from proofdesk.llm.base import give_back

CLASHING = ("_text", "_id", "_cut", "_spans", "_gone", "_row", "row", "id", "spans", "cut", "twin", "score", "predicted", "kept", "component_id", "n", "stratum", "max_marks", "_w", "digest")


def test_columns_of_the_caller_come_back_as_they_were(spark):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(d, t, "en", *("mine" for _ in CLASHING)) for d, t in ((1, text), (2, text + " tail"), (3, " ".join(f"own{i}" for i in range(60))), (None, text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    stages = {"quality": lambda: quality.keep_good(docs, labels), "toxicity": lambda: toxicity.drop_toxic(docs, labels), "near": lambda: jaccard.drop_near_duplicates(docs),
              "spans": lambda: chunks.drop_spans(docs)}
    left = {"quality": 4, "toxicity": None, "near": 3, "spans": 4}
    for name, stage in stages.items():
        got = stage().collect()
        assert stage().schema == docs.schema and all(g[c] == "mine" for g in got for c in CLASHING), name
        assert left[name] in (None, len(got)), name
    assert sorted(len(g["text"].split()) for g in chunks.drop_spans(docs).collect()) == [1, 60, 70, 70]


def test_one_text_of_a_repeated_id_stays_whatever_the_order(spark):
    rows = [(9, "first text here", "b"), (9, "quite another text", "a"), (9, "first text here", "a")]
    kept = [[tuple(x) for x in jaccard.drop_near_duplicates(spark.createDataFrame(r, "doc_id long, text string, part string")).collect()] for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0][2] == "a"


def test_weights_do_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(i, f"good words number {i % 7} here" if i % 2 else f"vile words number {i % 7} there") for i in range(60)] + [(i, f"other text {i}") for i in range(0, 60, 3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    frames = [spark.createDataFrame(r, "doc_id long, text string").repartition(3) for r in (rows, rows[::-1])]
    assert toxicity.fit(frames[0], labels) == toxicity.fit(frames[1], labels)


def test_empty_tables_pass_every_stage(spark, no_docs, labels):
    for stage in (lambda d: quality.keep_good(d, labels), lambda d: toxicity.drop_toxic(d, labels), jaccard.drop_near_duplicates, chunks.drop_spans):
        got = stage(no_docs)
        assert got.schema == no_docs.schema and got.count() == 0


def test_pages_are_given_back():
    give_back()
