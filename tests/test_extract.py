import hashlib
import json
import re
import urllib.error

import pytest
from pyspark.sql import functions as F

from proofdesk.cli import verify
from proofdesk.operators import extract as X
from proofdesk.sources import pages as SP


def section(block, q, a):
    return f'<div class="schema-faq-section" id="{block}"><strong class="schema-faq-question">{q}</strong> <p>{a}</p></div>'


def page(pid, body, link="https://s/x/"):
    return {"id": pid, "link": link, "modified": "2024-01-01T00:00:00", "content": {"rendered": body}}


def load(spark, tmp_path, pages):
    (tmp_path / "p.json").write_text(json.dumps(pages))
    return X.extract_entries(SP.load_pages(spark, str(tmp_path / "p.json"))).orderBy("entry_ord").collect()


def test_sections_suffixes_and_dropped_blocks(spark, tmp_path):
    body = (section("q", "One", "No. 4&#189; <em class='k'>boxes</em><br />left") + section("q", "", "no question") + section("r", "R", "r &amp;lt;")
            + section("q", "Two", " <p> </p>") + '<div class="schema-faq-section" id="z">no question tag</div>' + section("q", "Three", "a<div>in</div>cut"))
    got = load(spark, tmp_path, [page(7, body), page(8, "<p>nothing</p>"), page(9, section("q", "Solo", "s"))])
    assert [(r["id"], r["question"], r["answer"]) for r in got] == [
        ("7:q", "One", "No. 4½ boxes\nleft"), ("7:r", "R", "r &lt;"), ("7:q#2", "Three", "ain"), ("9:q", "Solo", "s")]
    assert [r["entry_ord"] >> X.SECTION_BITS for r in got] == [0, 0, 0, 2]


def test_ordinals_refuse_to_spill_or_wrap(spark):
    for outer, inner in ((0, 1 << 14), (1 << 49, 0), (-1, 0)):
        with pytest.raises(Exception, match="ordinal exceeds"):
            spark.range(1).select(X.pack_ordinal(F.lit(outer), F.lit(inner), 14)).collect()
    assert spark.range(1).select(X.pack_ordinal(F.lit((1 << 49) - 1), F.lit((1 << 14) - 1), 14)).first()[0] == (1 << 63) - 1


def test_a_page_may_have_very_many_sections(spark, tmp_path):
    got = load(spark, tmp_path, [page(1, "".join(section(f"s{i}", f"Q{i}", "a") for i in range(20_000))), page(2, section("z", "Last", "b"))])
    assert len(got) == 20_001 and got[19_999]["question"] == "Q19999" and got[-1]["id"] == "2:z"


def test_pages_without_an_ordinal_are_numbered_densely(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = [json.dumps(page(i, section("b", f"Q{i}", "a"))) for i in range(10)]
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(3).write.text(folder)
    pages = SP.load_pages(spark, folder)
    assert sorted(r["page_ord"] for r in pages.select("page_ord").collect()) == list(range(10))


def test_verify_reports_what_the_page_lacks(spark, tmp_path):
    body = section("a", "Q", "Shown <b>fully</b>.") + section("b", "Q2", "in<i>line</i>")
    (tmp_path / "p.json").write_text(json.dumps([page(1, body)]))
    shown = "<html><p>shown   fully .</p><p>Shown fully.</p> in<i>line</i></html>"
    counts, missing, prints = verify(spark, str(tmp_path / "p.json"), fetch=lambda url: shown)
    assert [tuple(r) for r in counts.collect()] == [("https://s/x/", 2, 1)]
    assert [r["id"] for r in missing.collect()] == ["1:b"], "tags inside a word split it when displayed"
    assert prints.first()["sha256"] == hashlib.sha256((tmp_path / "p.json").read_bytes()).hexdigest()
    counts, _, _ = verify(spark, str(tmp_path / "p.json"), ["https://s/x/"], fetch=lambda url: shown)
    assert counts.count() == 0


def test_a_page_given_twice_is_an_error(spark):
    entries = spark.createDataFrame([(0, "a", "u", "x")], "entry_ord long, id string, url string, answer string")
    with pytest.raises(Exception, match="page given twice: u"):
        X.check_entries(entries, spark.createDataFrame([("u", "x"), ("u", "y")], "url string, html string")).collect()


def test_displayed_pages_come_in_host_lanes_and_are_taken_up_again(spark, tmp_path):
    store, log = str(tmp_path / "shown"), tmp_path / "log"
    log.mkdir()
    urls = spark.createDataFrame([(f"https://h{i % 3}.example/{i // 3}",) for i in range(12)] * 2 + [(None,)], "url string")

    def fetch(bad):
        def get(url):
            import os
            import time
            import uuid
            (log / uuid.uuid4().hex).write_text(f"{time.time()} {os.getpid()} {url}")
            if url in bad:
                raise OSError("unreachable")
            return f"<p>{url}</p>"
        return get

    def asked():
        return sorted(p.read_text().split() for p in log.iterdir())

    with pytest.raises(RuntimeError, match="1 pages were not fetched, the others are kept; https://h1.example/2: OSError: unreachable"):
        SP.fetch_displayed(urls, fetch({"https://h1.example/2"}), pause=0.3, lanes=3, store=store)
    assert len(asked()) == 12, "each distinct url once, a failed one too"
    for host in ("h0", "h1", "h2"):
        own = [(float(t), pid) for t, pid, u in asked() if f"/{host}." in u]
        assert len({pid for _, pid in own}) == 1 and all(b[0] - a[0] >= 0.3 for a, b in zip(own, own[1:])), "one paced lane a host"
    got = SP.fetch_displayed(urls, fetch(()), pause=0.0, store=store).collect()
    assert sorted(r["url"] for r in got) == sorted({f"https://h{i % 3}.example/{i // 3}" for i in range(12)}) and all(r["html"] == f"<p>{r['url']}</p>" for r in got)
    assert [u for _, _, u in asked()][12:] == ["https://h1.example/2"], "nothing is fetched twice"
    with pytest.raises(Exception, match="unreachable"):
        SP.fetch_displayed(urls, fetch({"https://h1.example/2"})).collect()


def test_rest_source_pages_until_short_or_400(spark, tmp_path):
    def site(total, past_end):
        def get(url):
            per, n = map(int, re.search(r"per_page=(\d+)&page=(\d+)", url).groups())
            batch = [page(i, section("q", f"Q{i}", "a")) for i in range(total)][(n - 1) * per:n * per]
            if not batch and (past_end or total == 0):
                raise urllib.error.HTTPError(url, 400, "no", {}, None)
            return json.dumps(batch).encode()

        class Fake(SP.RestPages):
            get = None

            @classmethod
            def name(cls):
                return f"fake{total}{past_end}"
        Fake.get = staticmethod(get)
        return Fake

    for total, past_end, lanes in ((5, False, 1), (4, True, 1), (4, False, 3), (5, True, 3)):
        out = str(tmp_path / f"o{total}{past_end}{lanes}")
        SP.fetch_pages(spark, "https://s/", out, site(total, past_end), per_page=2, pause=0, lanes=lanes)
        got = X.extract_entries(SP.load_pages(spark, out)).orderBy("entry_ord").collect()
        assert [r["question"] for r in got] == [f"Q{i}" for i in range(total)]
        assert SP.fetch_pages(spark, "https://s/", out, None) == out, "a finished landing is reused"
    with pytest.raises(Exception):
        SP.fetch_pages(spark, "https://s/", str(tmp_path / "none"), site(0, True), per_page=2, pause=0)


def test_a_url_with_several_pages_is_checked_page_by_page(spark, tmp_path):
    from proofdesk.plans import queries as Q
    rows = [(0, "https://u/", "<p>one</p><p>two &amp; a half</p><ul><li>a</li><li>b</li></ul>"), (1, "https://u/", "<p>three</p>"), (2, "https://v/", "<p>four</p>"), (3, None, "<p>five</p>"),
            (4, "https://w/", "nothing"), (5, "https://w/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {tuple(r) for r in Q.page_verify(spark, str(tmp_path)).collect()} == {("https://u/", 4, 1), ("https://v/", 1, 0), (None, 1, 0)}
    assert {tuple(r) for r in Q.page_missing(spark, str(tmp_path)).collect()} == {("https://u/", "0:2")}
    pages = spark.createDataFrame([(1, "x"), (1, "y")], "page_id long, html string")
    with pytest.raises(Exception, match="page given twice: 1"):
        X.check_entries(spark.createDataFrame([(0, "a", "u", 1, "x")], "entry_ord long, id string, url string, page_id long, answer string"), pages, "page_id").collect()
