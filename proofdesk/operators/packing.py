"""Units of evidence, and packing ranked candidates into a word budget.

A query's candidates are at most `CANDIDATES`, so packing works on one bounded array or group per query.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import BROADCAST_MAX_BYTES, cut_lineage
from .extract import WINDOW_BITS, pack_ordinal

# Default budget and the mark printed between non-adjacent sentences.
MAX_CONTEXT_BYTES = 64 << 20
BUDGET_WORDS = 1000
GAP = "[...]"
PARTS = "array<struct<i:int,s:int,t:string>>"
ATTACH_LIMIT = 1_000_000


def _head():
    return T.header(F.col("url"), F.col("modified"), F.col("question"))


def answer_units(entries: DataFrame) -> DataFrame:
    """Whole entries with their header: (unit_ord, entry_ord, text)."""
    return entries.select(F.col("entry_ord").alias("unit_ord"), "entry_ord",
                          T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer")).alias("text"))


def passage_units(entries: DataFrame) -> DataFrame:
    """Sentence windows, each prefixed by its entry's header: (unit_ord, entry_ord, k, text)."""
    w = T.window_rows(entries.select("entry_ord", "answer", _head().alias("head")), "answer", "entry_ord", "head")
    return w.select(pack_ordinal(F.col("entry_ord"), F.col("k"), WINDOW_BITS).alias("unit_ord"), "entry_ord", "k",
                    F.concat("head", F.lit(" "), "window").alias("text"))


def attach(candidates: DataFrame, units: DataFrame, bounded_rows: int, limit: int = ATTACH_LIMIT) -> DataFrame:
    """Look the candidates' columns up in `units`. `bounded_rows` (queries x k) decides broadcast or shuffle."""
    side = F.broadcast(candidates) if bounded_rows <= limit else candidates
    return units.join(side, "unit_ord")


def pack_answers(ranked: DataFrame, budget: int = BUDGET_WORDS) -> DataFrame:
    """Greedy in `position` order; a unit that would exceed the budget is skipped and smaller ones still tried.

    ranked(query_id, position, unit_ord, text) -> (query_id, context, context_words, units array<bigint>)
    """
    item = F.struct("position", "unit_ord", T.nwords(F.col("text")).alias("n"), "text")
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))

    def step(acc, i):
        n = F.get(F.col("c.n"), i)
        return F.when(acc["used"] + n <= budget, F.struct(
            (acc["used"] + n).alias("used"), F.concat(acc["at"], F.array(i)).alias("at"))).otherwise(acc)

    folded = listed.select("query_id", "c", F.aggregate(F.sequence(F.lit(0), F.size("c") - 1), start, step).alias("f"))
    return folded.select("query_id", F.array_join(F.transform("f.at", lambda i: F.get(F.col("c.text"), i)), "\n\n").alias("context"),
                         F.col("f.used").alias("context_words"),
                         F.transform("f.at", lambda i: F.get(F.col("c.unit_ord"), i)).alias("units"))


# ---------- passages ----------

def _covers(n, k, i):
    """Whether window k of an answer of n sentences holds sentence i."""
    first = k * T.WINDOW_STRIDE
    return (n <= T.WINDOW_SIZE) | ((i >= first) & (i < first + T.WINDOW_SIZE))


def passage_hits(ranked: DataFrame, entries: DataFrame, bounded_rows: int) -> DataFrame:
    """Each hit with its neighbouring windows (`near`) and the sentences of these alone (`parts`: number, words, text).

    Answers are split once per entry that has a hit; what leaves the join is a few sentences and their count, however long the answer.
    """
    hits = ranked.select("query_id", "position", F.shiftright("unit_ord", WINDOW_BITS).alias("unit_ord"), (F.col("unit_ord") % (1 << WINDOW_BITS)).cast("int").alias("k"))
    wanted = hits.select("unit_ord").distinct()
    found = entries.withColumnRenamed("entry_ord", "unit_ord").join(F.broadcast(wanted) if bounded_rows <= ATTACH_LIMIT else wanted, "unit_ord", "left_semi")
    split = found.select("unit_ord", _head().alias("head"), T.sentences(F.col("answer")).alias("sents"))
    n, size, step = F.size("sents"), T.WINDOW_SIZE, T.WINDOW_STRIDE
    windows = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.floor((n - size + 2 * step - 1) / step).cast("int"))
    near = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("k") + d), lambda k: (k >= 0) & (k < F.col("windows")))
    first = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.greatest(F.col("k") - 1, F.lit(0)) * step)
    last = F.when(F.col("n") <= size, F.col("n")).otherwise(F.least(F.col("n"), (F.col("k") + 1) * step + size))
    parts = F.transform(F.slice("sents", F.col("first") + 1, F.greatest(F.col("last") - F.col("first"), F.lit(0))),
                        lambda t, i: F.struct((F.col("first") + i).alias("i"), T.nwords(t).alias("s"), t.alias("t")))
    rows = attach(hits, split, bounded_rows).withColumns({"n": n, "windows": windows}).withColumns({"first": first, "last": last})
    return rows.select("query_id", "position", F.col("unit_ord").alias("e"), "head", T.nwords(F.col("head")).alias("hw"), "n", near.alias("near"), parts.alias("parts"))


def _total(sizes):
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)


def _gaps(picked):
    """How many neighbours of the sorted sentences are not next to each other."""
    return _total(F.zip_with(F.slice(picked, 1, F.size(picked) - 1), F.slice(picked, 2, F.size(picked) - 1), lambda a, b: F.when(b["i"] - a["i"] > 1, 1).otherwise(0)))


def _pick_sentences(x, block, new):
    """(what the block holds after the windows `new`, its words): overlapping sentences once, a mark at each gap."""
    more = F.filter(x["parts"], lambda q: F.exists(new, lambda k: _covers(x["n"], k, q["i"])))
    picked = F.array_sort(F.array_union(F.coalesce(block["p"], F.array().cast(PARTS)), more))
    return picked, lambda p: x["hw"] + _total(F.transform(p, lambda q: q["s"])) + _gaps(p)


def _pick_windows(x, block, new):
    """The same where every window is charged and printed on its own, each with the header's words."""
    def window(k):
        own = F.filter(x["parts"], lambda q: _covers(x["n"], k, q["i"]))
        return F.struct(k.alias("i"), (x["hw"] + _total(F.transform(own, lambda q: q["s"]))).alias("s"), F.array_join(F.transform(own, lambda q: q["t"]), " ").alias("t"))
    return F.array_sort(F.concat(F.coalesce(block["p"], F.array().cast(PARTS)), F.transform(new, window))), lambda p: _total(F.transform(p, lambda q: q["s"]))


def _joined(picked):
    """Sentences in order, the gap mark where some are left out."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit("").alias("text"))
    mark = lambda a, q: F.when(a["last"].isNull(), "").when(q["i"] - a["last"] > 1, f" {GAP} ").otherwise(" ")
    return F.aggregate(picked, start, lambda a, q: F.struct(q["i"].alias("last"), F.concat(a["text"], mark(a, q), q["t"]).alias("text")), lambda a: a["text"])


def pack_passages(ranked: DataFrame, entries: DataFrame, bounded_rows: int, budget: int = BUDGET_WORDS,
                  version: int = 2) -> DataFrame:
    """ranked(query_id, position, unit_ord of passage_units) -> (query_id, context, context_words).

    Each hit brings its neighbouring windows. Version 2 charges the words of the rendered text: one header per
    entry, overlapping sentences once, a gap mark between non-adjacent ones. Version 1 charges every window with
    its own header and prints overlaps twice. A query's hits, `CANDIDATES` at most, are folded in order; the state is a block for each entry
    that was taken: its windows, and its sentences or window texts in order. A hit that would exceed the budget is skipped.
    """
    pick = _pick_sentences if version >= 2 else _pick_windows
    item = F.struct("position", "e", "head", "hw", "n", "near", "parts")
    listed = passage_hits(ranked, entries, bounded_rows).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<e:bigint,head:string,w:array<int>,p:{PARTS},words:int>>").alias("blocks"))

    def step(acc, x):
        def with_new(block, new):
            picked, words = pick(x, block, new)
            return T.named(picked, lambda p: T.named(words(p), lambda n: after(block, new, p, n)))

        def after(block, new, p, n):
            used = acc["used"] + n - F.coalesce(block["words"], F.lit(0))
            mine = F.struct(x["e"].alias("e"), x["head"].alias("head"), F.concat(F.coalesce(block["w"], F.array().cast("array<int>")), new).alias("w"), p.alias("p"), n.alias("words"))
            blocks = F.when(block.isNull(), F.concat(acc["blocks"], F.array(mine))).otherwise(F.transform(acc["blocks"], lambda b: F.when(b["e"] == x["e"], mine).otherwise(b)))
            return F.when((F.size(new) > 0) & (used <= budget), F.struct(used.alias("used"), blocks.alias("blocks"))).otherwise(acc)

        return T.named(F.get(F.filter(acc["blocks"], lambda b: b["e"] == x["e"]), 0), lambda block: T.named(
            F.array_except(x["near"], F.coalesce(block["w"], F.array().cast("array<int>"))), lambda new: with_new(block, new)))

    packed = listed.select("query_id", F.aggregate("c", start, step).alias("f"))
    text = _joined if version >= 2 else (lambda p: F.array_join(F.transform(p, lambda q: q["t"]), f" {GAP} "))
    context = F.array_join(F.transform("f.blocks", lambda b: F.concat(b["head"], F.lit("\n"), text(b["p"]))), "\n\n")
    return packed.select("query_id", context.alias("context")).select("query_id", "context", T.nwords(F.col("context")).alias("context_words"))


# ---------- whole corpus ----------

def ordered_entries(visible: DataFrame, *corpus: str) -> DataFrame:
    """Entries with the sort keys of the full-corpus reading order: page_modified, url, entry_ord.

    A page counts from the date of its first visible entry. The per-page aggregate is combined map-side and joined
    back, so a page with very many entries is never gathered; sorting by the keys is a range-partitioned sort.
    """
    first = visible.groupBy(*corpus, "url").agg(F.min_by("modified", "entry_ord").alias("page_modified"))
    return visible.join(first, [*corpus, "url"])


def full_context(visible: DataFrame, *corpus: str, max_bytes: int = MAX_CONTEXT_BYTES) -> DataFrame:
    """(corpus.., context): every visible entry of a corpus as one text, oldest page first.

    One text goes into one prompt, so each corpus is measured first; one over `max_bytes` is refused rather
    than cut, and stays available row by row from `ordered_entries`.
    """
    keyed = ordered_entries(visible, *corpus).select(*corpus, F.struct(
        "page_modified", "url", "entry_ord",
        T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer")).alias("text")).alias("e"))
    size = F.sum(F.octet_length("e.text").cast("bigint"))
    _refuse_beyond(max_bytes, keyed.groupBy(*corpus).agg(size.alias("b")).agg(F.max("b")).first()[0])
    return keyed.groupBy(*corpus).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("e")), lambda x: x["text"]), "\n\n").alias("context"))


def _refuse_beyond(max_bytes: int, largest: int | None) -> None:
    if (largest or 0) > max_bytes:
        raise ValueError(f"a corpus of {largest} bytes cannot be one prompt (limit {max_bytes}); "
                         "leave the full-corpus reader out or read it with ordered_entries")


def held_contexts(entries: DataFrame, removed: DataFrame, corpora: DataFrame, *site: str, max_bytes: int = MAX_CONTEXT_BYTES) -> DataFrame:
    """(site.., held_ord, context): the text of each corpus, which is its site without the entries removed from it.

    entries(site.., entry_ord, url, modified, question, answer), removed(site.., held_ord, entry_ord), corpora(site.., held_ord); without
    `site` all entries are one. Repeated rows count once, removed entries that the site lacks are ignored, a corpus without entries has the text "".

    The entries of a site are put in order once. A corpus is a short list of stretches of that order: what lies between its removed entries,
    and the rest of a page whose first entries are removed, if the page counts from another date then. So entries are never multiplied by corpora:
    the sizes come by subtraction, and the stretches from as many rows as are removed. A corpus over `max_bytes` is refused.
    """
    at, key = list(site), [*site, "held_ord"]
    if not site:
        at, key = ["_site"], ["_site", "held_ord"]
        entries, removed, corpora = (d.withColumn("_site", F.lit(0)) for d in (entries, removed, corpora))
    wanted = corpora.select(*key).distinct()
    text = T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer"))
    weighed = entries.select(*at, "entry_ord", F.octet_length(text).cast("bigint").alias("bytes"))
    whole = weighed.groupBy(*at).agg(F.sum("bytes").alias("bytes"), F.count("*").cast("int").alias("n"))
    lost = removed.select(*key, "entry_ord").distinct().join(wanted, key, "left_semi")
    less = lost.join(weighed, [*at, "entry_ord"]).groupBy(*key).agg(F.sum("bytes").alias("less"))
    sized = wanted.join(whole, at).join(less, key, "left").select((F.col("bytes") - F.coalesce("less", F.lit(0))).alias("left"))
    _refuse_beyond(max_bytes, sized.agg(F.max("left")).first()[0])

    # From here on a site is what fits into one prompt and what is removed from it.
    ordered = ordered_entries(entries, *at).select(*at, "page_modified", "url", "entry_ord", "modified", text.alias("text"))
    reading = Window.partitionBy(*at).orderBy("page_modified", "url", "entry_ord")
    page = Window.partitionBy(*at, "url").orderBy("entry_ord")
    places = cut_lineage(ordered.select(*at, "page_modified", "url", "entry_ord", "modified").select(
        "*", (F.row_number().over(reading) - 1).alias("place"), (F.row_number().over(page) - 1).alias("nth")))
    gone = cut_lineage(lost.join(places, [*at, "entry_ord"]))

    cuts = _cuts(gone, places, wanted.join(whole.select(*at, "n"), at), at, key)
    earlier = Window.partitionBy(*key, "page").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    kept = cuts.withColumn("from", F.max("hi").over(earlier)).where(F.col("lo") > F.col("from"))
    piece = F.struct(F.coalesce("before", "from").alias("at"), F.col("before").isNull().alias("base"), "dated", "page", "from", (F.col("lo") - F.col("from")).alias("n"))
    listed = kept.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    item = F.struct("page_modified", "url", "entry_ord", "text")
    texts = ordered.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]).alias("texts"))
    if (whole.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_MAX_BYTES // 2:
        texts = F.broadcast(texts)
    shown = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice("texts", p["from"] + 1, p["n"]))), "\n\n")
    found = listed.join(texts, at).select(*key, shown.alias("context"))
    return wanted.join(found, key, "left").select(*site, "held_ord", F.coalesce("context", F.lit("")).alias("context"))


def _cuts(gone: DataFrame, places: DataFrame, counted: DataFrame, at: list[str], key: list[str]) -> DataFrame:
    """(key.., page, lo, hi, before, dated): what a corpus leaves out of the order, [lo, hi) each.

    What lies between two cuts is kept. `page` is null in the order of the site; the rest of a page that moves has cuts of its own, and goes `before`
    the place of the first page that comes later than it by its new date.
    """
    run = Window.partitionBy(*key, "url").orderBy("nth")
    lost = gone.withColumn("run", F.row_number().over(run) - 1).where(F.col("run") == F.col("nth")).groupBy(*key, "url").agg(
        F.count("*").cast("int").alias("nth"), F.first("page_modified").alias("was"))
    pages = places.groupBy(*at, "url").agg(F.first("page_modified").alias("page_modified"), F.min("place").alias("start"), (F.max("place") + 1).alias("stop"))
    moved = (lost.join(places.select(*at, "url", "nth", F.col("modified").alias("dated"), F.col("place").alias("lo")), [*at, "url", "nth"])
             .where(~F.col("dated").eqNullSafe(F.col("was"))).join(pages.select(*at, "url", "stop"), [*at, "url"])
             .select(*key, F.col("url").alias("page"), "lo", F.col("stop").alias("hi"), "dated"))
    order = pages.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("page_modified", "url", "start"))).alias("pages"), F.max("stop").alias("n"))
    later = F.filter("pages", lambda p: F.struct(p["page_modified"], p["url"]) > F.struct(F.col("dated").alias("page_modified"), F.col("page").alias("url")))
    moved = moved.join(order, at).withColumn("before", F.coalesce(F.get(later, 0)["start"], F.col("n"))).drop("pages", "n")

    def cut(df, lo, hi, page="cast(null as string)", before="cast(null as int)", dated="cast(null as string)"):
        return df.select(*key, *(F.expr(e).alias(n) for e, n in ((page, "page"), (lo, "lo"), (hi, "hi"), (before, "before"), (dated, "dated"))))

    own = ("page", "before", "dated")
    inside = gone.select(*key, F.col("url").alias("page"), "place").join(moved, [*key, "page"]).where(F.col("place") >= F.col("lo"))
    parts = [cut(counted, "0", "0"), cut(counted, "n", "n"), cut(gone, "place", "place + 1"), cut(moved, "lo", "hi"), cut(moved, "before", "before"),
             cut(moved, "lo", "lo", *own), cut(moved, "hi", "hi", *own), cut(inside, "place", "place + 1", *own)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
