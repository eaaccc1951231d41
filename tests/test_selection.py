import hashlib
import random

import pytest

from proofdesk.operators import sampling
from proofdesk.sources import pages


@pytest.mark.parametrize("ranges, group", [(4_096, 64), (9, 4), (1, 1)])
def test_sample_equals_random_sample_of_the_sorted_rows(spark, monkeypatch, ranges, group):
    monkeypatch.setattr(sampling, "RANGES", ranges)
    monkeypatch.setattr(sampling, "GROUP", group)
    r = random.Random(4)
    rows = [(f"{r.choice(['a', 'ab', 'é', '\"q\"', ''])}{r.randint(0, 400)}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, entry_ord long").repartition(7)
    for n, seed in ((0, 1), (1, 2), (40, 3), (500, 4)):
        got = [tuple(x)[:2] for x in sampling.seeded_sample(df, n, seed, "id", "entry_ord").orderBy("sample_ord").collect()]
        assert got == random.Random(seed).sample(sorted(rows), n)
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, 501, 1, "id", "entry_ord")


def test_equal_keys_are_counted_not_sorted(spark, monkeypatch):
    """Two thirds of the rows share one key; every drawn position of it finds that key."""
    monkeypatch.setattr(sampling, "RANGES", 16)
    monkeypatch.setattr(sampling, "GROUP", 4)
    keys = [7] * 200 + list(range(100, 200))
    chosen = sampling.seeded_sample(spark.createDataFrame([(k,) for k in keys], "k int"), 30, 5, "k").select("k", "sample_ord").distinct()
    assert sorted((x["sample_ord"], x["k"]) for x in chosen.collect()) == list(enumerate(random.Random(5).sample(sorted(keys), 30)))


def test_sample_plan_has_no_global_sort(spark):
    df = spark.range(10_000).selectExpr("id", "cast(id as string) as s")
    plan = sampling.seeded_sample(df, 5, 1, "s", "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[_r", "").replace("LocalTableScan", "")


def test_empty_population(spark):
    df = spark.createDataFrame([], "k string")
    assert sampling.seeded_sample(df, 0, 1, "k").count() == 0
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, 1, 1, "k")


def test_fingerprint_digests_files_of_any_length(spark, tmp_path):
    (tmp_path / "a b%20.json").write_bytes(b"x" * 20_000_001)
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "sparse", "wb") as f:  # more than one binary value of Spark holds; takes no disk
        f.truncate((2 << 30) + 5)
    got = {r["file"]: r["sha256"] for r in pages.fingerprint(spark, str(tmp_path)).collect()}
    zeros = hashlib.sha256()
    for _ in range(2 << 6):
        zeros.update(bytes(16 << 20))
    zeros.update(bytes(5))
    assert got == {"a b%20.json": hashlib.sha256(b"x" * 20_000_001).hexdigest(), "empty": hashlib.sha256().hexdigest(), "sparse": zeros.hexdigest()}


def test_fingerprint_through_a_given_opener(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")

    def opened(path):
        import io
        return io.BytesIO(b"<" + open(path.removeprefix("file:"), "rb").read())

    assert pages.fingerprint(spark, str(tmp_path), opened).collect()[0]["sha256"] == hashlib.sha256(b"<abc").hexdigest()
