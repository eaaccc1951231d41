"""Registered queries: every operator over whole driver tables.

The tables stand in for the operators' inputs: documents are entries (page = source and language), benchmark
items are customer emails and held-out entries, pages are displayed pages, labels and events are graded rows.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import extract, grading, lookup, packing, ranking, rerank, sampling, variants
from ..sources import pages as SP
from ..sources import tables as S
from . import workflow as W

DIGITS = 6
FIRST_CLAUSE = r"^[^.!?\n]*"
BUDGET = 1000
ENGLISH_PAGES = [f"https://src{i}.example/en/" for i in range(20)]
EXCLUDED_PAGES = ["https://src0.example/en/", "https://src7.example/fr/"]
MIN_SHARED = 10
SAMPLE, SEED = 40, 7


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return S.read_table(spark, f"{sf}/{name}.parquet")


def _big(c):
    return c.cast("bigint")


def _entries(spark, sf) -> DataFrame:
    """documents as entries: the first clause is the question, the whole text the answer."""
    n = F.col("n_chars")

    def two(m):
        return F.lpad((n % m + 1).cast("string"), 2, "0")

    return _t(spark, sf, "documents").select(
        F.col("doc_id").alias("entry_ord"), F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/")).alias("url"),
        F.concat(F.lit("2024-"), two(12), F.lit("-"), two(28), F.lit("T00:00:00")).alias("modified"),
        F.concat(F.lit("faq-"), n.cast("string")).alias("block"),
        F.regexp_extract("text", FIRST_CLAUSE, 0).alias("question"), F.col("text").alias("answer"))


def _held(spark, sf) -> DataFrame:
    return _t(spark, sf, "benchmark").select(
        F.col("item_id").alias("entry_ord"), F.concat(F.lit("bench:"), F.col("item_id").cast("string")).alias("id"),
        F.lit("https://bench.example/").alias("url"), F.concat(F.lit("faq-"), F.length("text").cast("string")).alias("block"),
        F.regexp_extract("text", FIRST_CLAUSE, 0).alias("question"), F.col("text").alias("answer"))


def _units(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("unit_ord"), "text")


def _emails(spark, sf) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------- text ----------

def token_counts(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("t"))
    return d.select("doc_id", _big(F.size("t")).alias("n_tokens"), _big(F.size(F.array_distinct("t"))).alias("n_distinct"))


def nwords(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", _big(T.nwords(F.col("text"))).alias("n_words"))


def sentences(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("i", "sentence")).where(F.col("i").isNotNull())
    return d.select("doc_id", _big(F.col("i")).alias("sent_ord"), "sentence")


def windows3(spark, sf):
    return T.window_rows(_t(spark, sf, "documents"), "text", "doc_id").select("doc_id", _big(F.col("k")).alias("k"), "window")


def chunk_words(spark, sf):
    return T.chunk_rows(_t(spark, sf, "documents"), "text", "doc_id").select("doc_id", _big(F.col("k")).alias("k"), "chunk")


def shingle_counts(spark, sf):
    return T.shingle_sets(_t(spark, sf, "documents"), "text", "doc_id").select("doc_id", _big(F.size("shingles")).alias("n_shingles"))


def html_clean(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.clean(F.col("html")).alias("cleaned"))


def visible_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.visible_text(F.col("html")).alias("shown"))


def quote_check(spark, sf):
    """Windows of a labelled document quoted against it; claimed answerable when its quality label is 1."""
    claims = _t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("claimed"))
    d = _t(spark, sf, "documents").join(claims, "doc_id").select(
        "doc_id", "claimed", T.quote_norm(F.col("text")).alias("hay"),
        F.concat(T.sentences(F.col("text")), F.array("lang", F.concat("lang", F.lit(" sentence that no document holds")))).alias("quotes"))
    d = d.select("doc_id", "claimed", F.size("quotes").alias("n"), F.size(W.quotes_found(F.col("quotes"), F.col("hay"))).alias("v"))
    return d.select("doc_id", _big(F.col("n")).alias("n_quotes"), _big(F.col("v")).alias("n_verified"),
                    (F.col("claimed") & (F.col("v") > 0)).cast("int").alias("answerable"))


def received_headers(spark, sf):
    e = _entries(spark, sf)
    text = T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer"))
    return e.select("entry_ord", F.inline(T.header_fields(text))).withColumnRenamed("entry_ord", "doc_id")


def json_fields(spark, sf):
    e = _t(spark, sf, "events").select("event_id", T.json_span(F.concat(
        F.lit("reply to "), "event_type", F.lit(":\n"), "props", F.lit("\ndone"))).alias("j"))
    return e.select("event_id", "j", _big(F.from_json("j", "k int")["k"]).alias("k"))


# ---------- extraction and verification ----------

def _wrapped(spark, sf) -> DataFrame:
    """One page per document whose lines are marked up as question/answer blocks with repeating block ids."""
    section = F.transform(F.split("text", "\n"), lambda ln, i: F.concat(
        F.lit('<div class="schema-faq-section" id="faq-'), (i % 3).cast("string"),
        F.lit('"><strong class="schema-faq-question">'), F.regexp_extract(ln, r"^[^.!?]*", 0),
        F.lit('</strong> <p class="schema-faq-answer">'), ln, F.lit("</p></div>")))
    return _t(spark, sf, "documents").select(
        F.col("doc_id").alias("page_ord"), F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/")).alias("link"),
        F.lit("2024-05-06T07:08:09").alias("modified"), F.struct(F.array_join(section, "").alias("rendered")).alias("content"))


def faq_extract(spark, sf):
    return extract.extract_entries(_wrapped(spark, sf)).select("id", "url", "modified", "block", "question", "answer")


def exclude_urls(spark, sf):
    kept = extract.exclude_urls(_entries(spark, sf), EXCLUDED_PAGES)
    return kept.groupBy("url").agg(F.count("*").alias("entries"))


def _page_entries(spark, sf) -> DataFrame:
    """Paragraphs and lists of the pages as entries that must show up on their own page.

    List items lose their tags when cleaned but turn into separate words when displayed, so lists are missing.
    """
    p = _t(spark, sf, "pages").select("page_id", "url", F.posexplode_outer(
        F.regexp_extract_all("html", F.lit(r"(?s)<p>.*?</p>|<ul>.*?</ul>"), F.lit(0))).alias("i", "raw")).where(F.col("i").isNotNull())
    return p.select(extract.pack_ordinal(F.col("page_id"), F.col("i"), extract.SECTION_BITS).alias("entry_ord"),
                    F.concat(F.col("page_id").cast("string"), F.lit(":"), F.col("i").cast("string")).alias("id"), "url", "page_id",
                    T.clean(F.col("raw")).alias("answer"))


def _checked(spark, sf) -> DataFrame:
    """Each page against its own displayed text; a url may have several pages."""
    return extract.check_entries(_page_entries(spark, sf), _t(spark, sf, "pages").select("page_id", "html"), "page_id")


def page_verify(spark, sf):
    return extract.check_summary(_checked(spark, sf))


def page_missing(spark, sf):
    return _checked(spark, sf).where("missing").select("url", "id")


def fingerprint(spark, sf):
    return SP.fingerprint(spark, f"{sf}/documents.parquet")


# ---------- variants ----------

def jaccard_pairs(spark, sf):
    held = _t(spark, sf, "benchmark").select(F.col("item_id").alias("held_ord"), "text")
    other = _t(spark, sf, "documents").select(F.col("doc_id").alias("entry_ord"), "text")
    return variants.jaccard_pairs(held, other).select(F.col("held_ord").alias("item_id"), F.col("entry_ord").alias("doc_id"),
                                                      F.round("jaccard", DIGITS).alias("jaccard"))


def containment(spark, sf):
    held = _t(spark, sf, "benchmark").select(F.col("item_id").alias("held_ord"), "text")
    other = _t(spark, sf, "documents").select(F.col("doc_id").alias("entry_ord"), "text")
    return variants.containment_pairs(held, other).select(
        F.col("held_ord").alias("item_id"), F.col("entry_ord").alias("doc_id"),
        F.round("held_in_other", DIGITS).alias("held_in_other"), F.round("other_in_held", DIGITS).alias("other_in_held"))


def holdout_semi(spark, sf):
    pairs = variants.variants(_entries(spark, sf), _held(spark, sf), question_ratio=None)
    return pairs.select(F.col("held_ord").alias("item_id"), F.col("entry_ord").alias("doc_id"))


def holdout_anti(spark, sf):
    kept, _ = variants.without_variants(_entries(spark, sf), _held(spark, sf), question_ratio=None)
    return kept.select(F.col("entry_ord").alias("doc_id"))


def title_ratio(spark, sf):
    pairs = variants.question_pairs(_held(spark, sf).withColumnRenamed("entry_ord", "held_ord"), _entries(spark, sf))
    return pairs.select(F.col("held_ord").alias("item_id"), F.col("entry_ord").alias("doc_id"), F.round("ratio", DIGITS).alias("ratio"))


def variants_all(spark, sf):
    pairs = variants.variants(_entries(spark, sf), _held(spark, sf))
    return pairs.select(F.col("held_ord").alias("item_id"), F.col("entry_ord").alias("doc_id"))


# ---------- ranking and packing ----------

def bm25_stats(spark, sf):
    return ranking.term_stats(_units(spark, sf)).select("term", "df", F.round("idf", DIGITS).alias("idf"))


def _named(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query_id").alias("item_id"), F.col("unit_ord").alias("doc_id"), "score", _big(F.col("rank")).alias("rank"))


def _lexical(spark, sf):
    return ranking.bm25_topk(_units(spark, sf), _emails(spark, sf), round_to=DIGITS)


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(units, queries) of the cosine queries."""
    e = _t(spark, sf, "embeddings")
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(
        e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return e.select(F.col("vec_id").alias("unit_ord"), "embedding"), asked


def _dense(spark, sf):
    return ranking.dense_topk(*_vectors(spark, sf), round_to=DIGITS)


def bm25_scores(spark, sf):
    scored = ranking.bm25_scores(_units(spark, sf), _emails(spark, sf), round_to=DIGITS)
    return scored.select(F.col("query_id").alias("item_id"), F.col("unit_ord").alias("doc_id"), "score")


def dense_scores(spark, sf):
    scored = ranking.dense_scores(*_vectors(spark, sf), round_to=DIGITS)
    return scored.select(F.col("query_id").alias("item_id"), F.col("unit_ord").alias("doc_id"), "score")


def bm25_top40(spark, sf):
    return _named(_lexical(spark, sf))


def dense_top40(spark, sf):
    return _named(_dense(spark, sf))


def rrf(spark, sf):
    fused = ranking.rrf([_lexical(spark, sf), _dense(spark, sf)], round_to=12)
    return _named(fused.withColumn("score", F.round("score", DIGITS)))


def _candidates(spark, sf) -> DataFrame:
    emails, lexical = _emails(spark, sf), _lexical(spark, sf).drop("score")
    named = packing.attach(lexical, _units(spark, sf), emails.count() * ranking.CANDIDATES)
    return named.join(emails.withColumnRenamed("text", "question"), "query_id")


def shared_words(query, docs):
    """Scorer: distinct shared tokens; candidates sharing fewer than MIN_SHARED are left out."""
    q = set(re.findall(T.TOKEN, query.lower()))
    shared = [len(q.intersection(re.findall(T.TOKEN, d.lower()))) for d in docs]
    return [float(n) if n >= MIN_SHARED else rerank.LEFT_OUT for n in shared]


def rerank_shared(spark, sf):
    got = rerank.rerank(_candidates(spark, sf), shared_words)
    return got.select(F.col("query_id").alias("item_id"), F.col("unit_ord").alias("doc_id"), "rerank_score", _big(F.col("position")).alias("position"))


def rerank_listwise(spark, sf):
    """Replies that list the 15 shortest candidates, shortest first."""
    c = _candidates(spark, sf)
    order = F.array_sort(F.collect_list(F.struct(T.nwords(F.col("text")).alias("n"), F.col("rank").alias("r"))))
    replies = c.groupBy("query_id").agg(order.alias("o")).select("query_id", F.concat(
        F.lit('Best first: {"ranking": ['), F.array_join(F.transform(F.slice("o", 1, 15), lambda x: (x["r"] + 1).cast("string")), ", "),
        F.lit("]}")).alias("result"))
    got = rerank.rerank_listwise(c, replies)
    return got.select(F.col("query_id").alias("item_id"), F.col("unit_ord").alias("doc_id"), _big(F.col("position")).alias("position"))


def _packed(spark, sf) -> DataFrame:
    return packing.pack_answers(_candidates(spark, sf).withColumnRenamed("rank", "position"), BUDGET)


def _packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("query_id").alias("item_id"), _big(F.col("context_words")).alias("context_words"),
                         F.array_join(F.transform("units", lambda u: u.cast("string")), ",").alias("units"), F.sha2("context", 256).alias("context_sha"))


def budget_pack(spark, sf):
    return _packed_columns(_packed(spark, sf))


def hybrid_pack(spark, sf):
    """The whole chain: BM25 and cosine ranks fused, the fused candidates reranked, those not left out packed into the budget."""
    emails = _emails(spark, sf)
    fused = ranking.rrf([_lexical(spark, sf), _dense(spark, sf)], round_to=12).select("query_id", "unit_ord", "rank")
    named = packing.attach(fused, _units(spark, sf), emails.count() * ranking.CANDIDATES).join(emails.withColumnRenamed("text", "question"), "query_id")
    return _packed_columns(packing.pack_answers(rerank.rerank(named, shared_words), BUDGET))


def passage_units(spark, sf):
    return packing.passage_units(_entries(spark, sf)).select("unit_ord", F.col("entry_ord").alias("doc_id"), _big(F.col("k")).alias("k"), "text")


def _passage_pack(spark, sf, version):
    entries, emails = _entries(spark, sf), _emails(spark, sf)
    ranked = ranking.bm25_topk(packing.passage_units(entries), emails, round_to=DIGITS).withColumnRenamed("rank", "position")
    packed = packing.pack_passages(ranked, entries, emails.count() * ranking.CANDIDATES, BUDGET, version)
    return packed.select(F.col("query_id").alias("item_id"), "context", _big(F.col("context_words")).alias("context_words"))


def passage_pack(spark, sf):
    return _passage_pack(spark, sf, 2)


def passage_pack_v1(spark, sf):
    return _passage_pack(spark, sf, 1)


def context_full(spark, sf):
    """The whole corpus in reading order, row by row: the order is that of the three key columns."""
    e = packing.ordered_entries(_entries(spark, sf))
    return e.select("page_modified", "url", F.col("entry_ord").alias("doc_id"),
                    T.header(F.col("url"), F.col("modified"), F.col("question")).alias("header"),
                    F.sha2(T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer")), 256).alias("text_sha")).orderBy("page_modified", "url", "doc_id")


def _turns(spark, sf) -> DataFrame:
    """Each conversation as a site of its own: a page per role, an entry per turn, dated by its length."""
    n = F.length("text")
    return _t(spark, sf, "conversations").select(
        "conv_id", F.col("turn").cast("bigint").alias("entry_ord"), F.concat(F.lit("https://conv.example/"), "role", F.lit("/")).alias("url"),
        F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("modified"), F.regexp_extract("text", FIRST_CLAUSE, 0).alias("question"),
        F.col("text").alias("answer"))


def page_contexts(spark, sf):
    """The joined text of each page of each conversation."""
    c = packing.full_context(_turns(spark, sf), "conv_id", "url")
    return c.select("conv_id", "url", _big(F.length("context")).alias("n_chars"), F.sha2("context", 256).alias("context_sha"))


def held_contexts(spark, sf):
    """The joined text of a conversation with a turn held out, and with it all turns that begin with the same word: once for every turn."""
    t = _turns(spark, sf)
    word = t.select("conv_id", "entry_ord", F.regexp_extract("answer", r"^\S*", 0).alias("w"))
    removed = word.withColumnRenamed("entry_ord", "held_ord").join(word, ["conv_id", "w"]).select("conv_id", "held_ord", "entry_ord")
    c = packing.held_contexts(t, removed, word.select("conv_id", F.col("entry_ord").alias("held_ord")), "conv_id")
    return c.select("conv_id", F.col("held_ord").alias("turn"), _big(F.length("context")).alias("n_chars"), F.sha2("context", 256).alias("context_sha"))


# ---------- sampling and lookups ----------

def pool_filter(spark, sf):
    return sampling.pool(_entries(spark, sf), ENGLISH_PAGES).select(F.col("entry_ord").alias("doc_id"), "id").orderBy("id")


def seeded_sample(spark, sf):
    pool = sampling.pool(_entries(spark, sf), ENGLISH_PAGES).select("id", "entry_ord", "question")
    return sampling.seeded_sample(pool, SAMPLE, SEED, "id", "entry_ord").select("sample_ord", "id", "question")


def lookup_strict(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("conv_id").alias("doc_id"))
    return lookup.lookup_strict(turns, _t(spark, sf, "documents"), "doc_id", "source").select("conv_id", "turn", "source")


def lookup_lenient(spark, sf):
    named = _t(spark, sf, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("label"))
    return lookup.lookup_lenient(_t(spark, sf, "documents").select("doc_id"), named, "doc_id", "label").select("doc_id", "label")


def only_cases(spark, sf):
    return lookup.only_ids(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id")


# ---------- grading ----------

def _replies(spark, sf) -> DataFrame:
    """Grader replies written from the labels, with words around the JSON and a third phrase to be cut."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    outcome = F.when(good & ~bad, "correct").when(good, "unsupported").when(~bad, "clarified").otherwise("lost condition")
    body = F.to_json(F.struct(outcome.alias("outcome"), F.concat("lang", F.lit(" "), "source").alias("evidence"),
                              F.array("lang", "source", F.lit("third")).alias("keeps"),
                              F.when(bad, F.array(F.lit("rude"))).otherwise(F.array().cast("array<string>")).alias("loses"),
                              F.col("n_chars").alias("size")))
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.concat(F.lit("My grade:\n"), body, F.lit("\nend")).alias("reply"))


def grade_parse(spark, sf):
    g = _replies(spark, sf).select("doc_id", "lang", grading.parse_grade("reply").alias("g"))
    return g.select("doc_id", "g.outcome", "g.evidence", F.array_join("g.keeps", "|").alias("keeps"), F.array_join("g.loses", "|").alias("loses"),
                    _big(F.col("g.extras")["size"]).alias("size"),
                    grading.success(F.col("g.outcome"), F.col("lang") == "en").cast("int").alias("success"))


def outcome_summary(spark, sf):
    """Graded rows per language (experiment) and source (reader)."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source")
    g = _replies(spark, sf).select("doc_id", grading.parse_grade("reply").alias("g"))
    rows = d.join(g, "doc_id").select(F.col("lang").alias("experiment"), F.col("source").alias("reader"), "g.outcome",
                                      grading.success(F.col("g.outcome"), F.col("lang") == "en").alias("success"))
    return grading.outcome_summary(rows)


def paired(spark, sf):
    """Events as graded rows: day = experiment, user = case, event type = reader; the last event of a kind counts."""
    reader = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "B").when(F.col("event_type") == "purchase", "C") \
        .otherwise("O")
    rows = _t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("experiment"), F.col("user_id").alias("case"),
                                          reader.alias("reader"), (F.col("value") >= 5).alias("success"), F.col("event_id").alias("row_ord"))
    return grading.paired(rows)


# ---------- calls, vectors, prompts ----------

def _requests(spark, sf) -> DataFrame:
    return _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text", S.call_key(
        F.col("role"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), F.col("text"), F.col("turn").cast("int")).alias("key"))


def call_key(spark, sf):
    return _requests(spark, sf).select("conv_id", "turn", "key")


def missing_calls(spark, sf):
    """User turns as requests; a turn followed by an assistant turn is an answered call."""
    c = _t(spark, sf, "conversations")
    asks = c.where(F.col("role") == "user").select("conv_id", "turn", S.call_key(F.lit("model"), F.lit(""), F.col("text")).alias("key"))
    replied = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    calls = asks.join(replied, ["conv_id", "turn"], "left_semi").select("key")
    return S.missing_calls(asks, calls).select("key")


def texts_to_embed(spark, sf):
    known = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left_semi").select(S.text_key(F.col("text")).alias("text_key"))
    return S.missing_texts(_t(spark, sf, "documents").select("text"), known).select("text_key")


def reply_overlap(spark, sf):
    """How much of each assistant turn's words and 3-word shingles the user's turn before it has."""
    c = _t(spark, sf, "conversations")
    replies = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))
    mails = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("mail"))
    return replies.join(mails, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("reply"), F.col("mail")), 6).alias("jaccard"),
                                                           F.round(T.containment(F.col("reply"), F.col("mail"), 3), 6).alias("held_in_mail"))


def answer_prompts(spark, sf):
    """Packed evidence to answering jobs: prompt, words and header lines of what each reader received."""
    packed = _packed(spark, sf).join(_emails(spark, sf), "query_id")
    prompt = P.fill(P.DEFAULTS["answer"], notes=F.lit("none"), context=F.col("context"), question=F.col("text"))
    return packed.select(F.col("query_id").alias("item_id"), F.sha2(prompt, 256).alias("prompt_sha"), _big(T.nwords(F.col("context"))).alias("context_words"))


def grader_prompts(spark, sf):
    """A grading request per assistant turn, the preceding user turn being the email."""
    c = _t(spark, sf, "conversations")
    drafts = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("draft"))
    mails = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("mail"))
    expect = F.struct(F.lit("answers").alias("does"), F.lit("").alias("must_not"), F.lit("keeps it short").alias("conditions"),
                      (F.col("turn") > 1).alias("clarify_ok"))
    r = drafts.join(mails, ["conv_id", "turn"]).select("conv_id", "turn", "mail", "draft", expect.alias("e"))
    prompt = P.grader_prompt(P.DEFAULTS, F.col("mail"), F.col("e"), F.lit("none"), F.col("draft"), F.col("mail"), F.lit(""))
    return r.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_sha"))


QUERIES = {f.__name__: f for f in (
    token_counts, nwords, sentences, windows3, chunk_words, shingle_counts, html_clean, visible_text, quote_check, received_headers,
    json_fields, faq_extract, exclude_urls, page_verify, page_missing, fingerprint, jaccard_pairs, containment, holdout_semi,
    holdout_anti, title_ratio, variants_all, bm25_stats, bm25_top40, bm25_scores, dense_top40, dense_scores, rrf, rerank_shared, rerank_listwise, budget_pack, hybrid_pack,
    passage_units, passage_pack, passage_pack_v1, context_full, page_contexts, held_contexts, pool_filter, seeded_sample, lookup_strict, lookup_lenient, only_cases,
    grade_parse, outcome_summary, paired, call_key, missing_calls, texts_to_embed, reply_overlap, answer_prompts, grader_prompts)}
