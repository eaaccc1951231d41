"""Objects of a JSON array by ranges of bytes, against the whole file parsed at once."""
import json
import random

import pytest

from proofdesk.sources import arrays as A
from proofdesk.sources import pages as SP


def values(draw, n):
    bits = ['"', "\\", "\\\\", "{", "}", "[", "]", "é", "\U0001f600", " ", "\n", "x" * 40, ",", ':"', "\\u"]
    word = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
    return [{"id": i, word(): word(), "deep": [{"a": {"b": [word()]}}, [], {}], "k": None} for i in range(n)]


@pytest.mark.parametrize("step", [1, 2, 7, 64, 10_000])
def test_any_cut_gives_the_same_objects(spark, tmp_path, step):
    draw = random.Random(step)
    want = values(draw, 3 if step < 7 else 25)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(want, ensure_ascii=step % 2 == 0, indent=draw.choice([None, 1])), encoding="utf-8")
    ranges = [(i, lo, min(lo + step, path.stat().st_size)) for i, lo in enumerate(range(0, path.stat().st_size, step))]
    with path.open("rb") as stream:  # the walk alone, with blocks shorter than any object
        A.BLOCK_BYTES, kept = 5, A.BLOCK_BYTES
        try:
            whole = [m for m in A._brackets(A._reader(stream), 0, ranges[-1][2], False) if m[1]]
            inside, parts = False, []
            for _, lo, hi in ranges:
                *own, (_, end) = A._brackets(A._reader(stream), lo, hi, inside)
                parts, inside = parts + own, end == A.QUOTE
        finally:
            A.BLOCK_BYTES = kept
    assert parts == whole and not inside
    if step >= 64:
        got = A.json_objects(spark, str(path), range_bytes=step).collect()
        assert sorted(r["at"] for r in got) == list(range(len(want)))
        assert [json.loads(r["value"]) for r in sorted(got, key=lambda r: r["at"])] == want


def test_odd_files(spark, tmp_path):
    def read(text, step=4):
        (tmp_path / "f.json").write_text(text)
        return sorted((r["at"], json.loads(r["value"])) for r in A.json_objects(spark, str(tmp_path / "f.json"), range_bytes=step).collect())

    (tmp_path / "none.json").write_text("")
    assert SP.load_pages(spark, str(tmp_path / "none.json")).count() == 0
    assert read("[]") == [] and read(" [ ] ") == []
    assert read('{"a": [{"b": 1}]}') == [(0, {"a": [{"b": 1}]})], "one object and no array"
    assert read('[1, "{", {"a": "]"}, null, [{"no": 1}], {}]') == [(0, {"a": "]"}), (1, {})]


def test_pages_of_one_file_spread_over_tasks(spark, tmp_path):
    pages = [{"id": i, "link": f"u{i}", "modified": "m", "content": {"rendered": f'<p class="{i}">\\ {{}} é' * 20}, "more": 1} for i in range(40)]
    (tmp_path / "p.json").write_text(json.dumps(pages))
    want = sorted(map(str, SP.load_pages(spark, str(tmp_path / "p.json")).collect()))
    listed = A.json_objects(spark, str(tmp_path / "p.json"), range_bytes=2_000)
    assert listed.rdd.glom().map(len).filter(bool).count() > 5
    by_spark = spark.read.option("multiLine", True).schema(SP.PAGE_SCHEMA).json(str(tmp_path / "p.json")).drop("page_ord").collect()
    assert len(want) == 40 and sorted(str(r) for r in SP.load_pages(spark, str(tmp_path / "p.json")).drop("page_ord").collect()) == sorted(map(str, by_spark))
    assert {(r["page_ord"], r["id"]) for r in SP.load_pages(spark, str(tmp_path / "p.json")).collect()} == {(i, i) for i in range(40)}
