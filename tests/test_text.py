import random
import re

from pyspark.sql import functions as F

from proofdesk.functions import text as T

PIECES = ["A", "b", " ", "  ", "\n", ".", "!", "?", "\t", "\r", " ", "\x1c", "(", '"', "'", "1", "é", "&amp;", "&lt;b&gt;",
          "&amp;lt;", "<br/>", "</p>", "<i>", "’", "“", "&nbsp;", "&copy", "\x85", " ", "　"]


def texts(n, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(PIECES) for _ in range(r.randint(0, 50)))) for i in range(n)]


SENTENCES = [
    ("One. Two! Three? 4th", ["One.", "Two!", "Three?", "4th"]), ("no capital. follows here", ["no capital. follows here"]),
    ('He said. "Yes." (Ok) then', ['He said.', '"Yes." (Ok) then']), ("line one\n\n line two.  Next", ["line one", "line two.", "Next"]),
    ("e.g. 5 of v1.2.3 are", ["e.g.", "5 of v1.2.3 are"]), ("   \n ", []), ("", []), ("Dots... 'Quoted'", ["Dots...", "'Quoted'"]), ("Tab.\tNext.\u00a0End", ["Tab.", "Next.", "End"]),
]
CLEANED = [
    ("<p>a</p><p>b<br/>c</p>", "a\nb\nc"), ("x <b>y</b>\u00a0\t z", "x y z"), ("<i></i>\n<br >\n", ""), ("&amp;lt;k&gt; &nbsp; r", "&lt;k> r"),
    ("one<BR>two", "onetwo"), ("  lead\n  and tail  ", "lead\nand tail"),
]
DISPLAYED = [("\u201cA\u201d \u2018b\u2019\n\u2003C&amp;D", "\"a\" 'b' c&d"), ("&quot;X&quot;", '"x"'), ("", ""), (" \u3000 ", ""), ("\u00c9t\u00c9", "\u00e9t\u00e9")]


def mapped(spark, f, table):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(table)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i")
    return [r["x"] for r in rows.collect()]


def test_text_tables(spark):
    for f, table in ((T.sentences, SENTENCES), (T.clean, CLEANED), (T.display_norm, DISPLAYED)):
        assert mapped(spark, f, table) == [want for _, want in table], f.__name__


def test_column_functions_match_python(spark):
    rows = texts(1500, 5)
    c = F.col("t")
    got = spark.createDataFrame(rows, "id long, t string").select(
        "id", T.nwords(c).alias("n"), T.split_words(c).alias("sw"), T.words(c).alias("w"), T.quote_norm(c).alias("q"), T.sentences(c).alias("s"),
        T.visible_text(c).alias("v"), T.display_norm(F.regexp_replace(c, "<[^>]+>", " ")).alias("d"), T.clean(c).alias("c")).collect()
    for (i, t), g in zip(rows, sorted(got)):
        assert g["n"] == len(t.split()) and g["sw"] == t.split()
        assert g["w"] == re.findall("[a-z0-9]+", t.lower())
        assert g["q"] == " ".join(t.replace("\u2019", "'").split()).lower()
        assert "".join("".join(g["s"]).split()) == "".join(t.split()), "sentences lose white space only"
        assert g["v"] == g["d"]
        assert all(line == line.strip() and line for line in g["c"].split("\n") if g["c"])


def test_visible_text_drops_scripts(spark):
    page = "<p>It&rsquo;s  <b>he</b>re</p><SCRIPT a='1'>var x = '</p>';\n</script><style>p{}</style> &amp;amp;"
    assert spark.createDataFrame([(page,)], "h string").select(T.visible_text(F.col("h"))).first()[0] == "it's he re &amp;"


def test_windows_chunks_shingles(spark):
    rows = [(n, " ".join(f"S{i} x." for i in range(n))) for n in range(0, 9)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {}
    for r in T.window_rows(df, "t", "id").orderBy("id", "k").collect():
        got.setdefault(r["id"], []).append(r["window"])
    for n, t in rows:
        s = [f"S{i} x." for i in range(n)]
        want = [" ".join(s)] if 0 < n <= 3 else [" ".join(s[i:i + 3]) for i in range(0, n - 1, 2)] if n else None
        assert got.get(n) == want
        assert all(any(x in w for w in got[n]) for x in s)
    words = [(n, " ".join(map(str, range(n)))) for n in (0, 1, 9, 10, 11, 17, 18, 25)]
    df = spark.createDataFrame(words, "id long, t string")
    got = {}
    for r in T.chunk_rows(df, "t", "id", size=10, overlap=2).orderBy("id", "k").collect():
        got.setdefault(r["id"], []).append(r["chunk"].split())
    for n, t in words[1:]:
        w = t.split()
        assert got[n] == ([w] if n <= 10 else [w[i:i + 10] for i in range(0, n - 2, 8)])
        assert got[n][-1][-1] == w[-1] and all(a[-2:] == b[:2] for a, b in zip(got[n], got[n][1:]))
    assert 0 not in got
    sets = {r["id"]: set(r["shingles"]) for r in T.shingle_sets(df.union(spark.createDataFrame([(99, "a b " * 20)], "id long, t string")), "t", "id").collect()}
    assert len(sets[99]) == 2 and len(sets[9]) == 2 and sets[1] == set() and len(sets[25]) == 18


def test_headers_round_trip_and_miss_broken_titles(spark):
    rows = [("https://a/", "2024-05-06T01:02:03", "Why [so]?", "x"), ("https://b/", "2023-01-01", "two\nlines", "y"),
            ("https://c/", "2022-02-02", "line inside", "z")]
    df = spark.createDataFrame(rows, "u string, m string, q string, a string")
    one = df.select(T.entry_text(F.col("u"), F.col("m"), F.col("q"), F.col("a")).alias("e")).collect()
    ctx = spark.createDataFrame([("\n\n".join(r["e"] for r in one),)], "c string").select(T.header_fields(F.col("c")).alias("h")).first()["h"]
    assert [(h["url"], h["updated"], h["entry"]) for h in ctx] == [
        ("https://a/", "2024-05-06", "Why [so]?"), ("https://c/", "2022-02-02", "line inside")]


def test_json_span(spark):
    df = spark.createDataFrame([('a {"x": {"y": 1}} b} c',), ("none",)], "t string").select(T.json_span(F.col("t")).alias("j"))
    assert [r["j"] for r in df.collect()] == ['{"x": {"y": 1}} b}', None]
