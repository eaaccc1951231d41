"""The evaluation as Spark jobs: prepare held-out questions, build contexts, answer, grade, report.

Everything lands under the config's `out` folder (shared storage on a cluster). Tables that several steps read
are written once and read back; model calls go through the call table, so a rerun pays only for what changed.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import extract, grading, lookup, packing, ranking, sampling, variants
from ..operators import rerank as RR
from ..sources import tables as S
from ..sources.pages import load_pages
from ..session import broadcast_if_bounded

# Config defaults and the wording that goes into result rows.
DEFAULT_BUSINESS = "a small business"
DEFAULT_RERANKER = "BAAI/bge-reranker-base"
DEFAULT_EMBEDDER = "BAAI/bge-small-en-v1.5"
LISTWISE_PREFIX = "llm:"
READERS = ("A", "B", "C", "O")
QUOTE_MIN_CHARS = 20
QUESTION_SOURCE = "reworded by us from the entry title"
TRANSFER_DOES = "gives the main action of the source answer below to this customer"
GRADED_WITH_SITE = "whole site"
FALSY_JSON = ["false", "0", "0.0", "", "null", "[]", "{}"]

GRADED_SCHEMA = ("row_ord bigint, experiment string, case string, reader string, context_words int, "
                 "received array<struct<url:string,updated:string,entry:string>>, answer string, usage map<string,string>, "
                 "answer_call string, grade_call string, outcome string, evidence string, keeps array<string>, "
                 "loses array<string>, extras map<string,string>, success boolean")
EXPECT = "struct<does:string,must_not:string,conditions:string,clarify_ok:boolean>"


def _texts(cfg) -> dict:
    return {**P.DEFAULTS, **cfg.get("prompts", {})}


def _calls(cfg) -> str:
    return cfg.path("out", "calls")


def _limit(cfg) -> int:
    """Bytes that one prompt may hold of a corpus: `max_context_bytes` of the config."""
    return cfg.get("max_context_bytes", packing.MAX_CONTEXT_BYTES)


def _table(cfg, name: str) -> str:
    return cfg.path("out", "tables", name)


def corpus(spark: SparkSession, cfg) -> DataFrame:
    """Extracted entries minus the excluded URLs, landed once per workflow."""
    entries = extract.extract_entries(load_pages(spark, cfg.path("pages")))
    return S.land(extract.exclude_urls(entries, cfg.get("exclude_urls", [])), _table(cfg, "entries"))


def _by_id(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries named by ids(id); of entries sharing an id the last one counts."""
    wanted = entries.join(broadcast_if_bounded(ids.select("id").distinct()), "id", "left_semi")
    fields = [c for c in wanted.columns if c != "id"]
    return wanted.groupBy("id").agg(F.max_by(F.struct(*fields), "entry_ord").alias("e")).select("id", "e.*")


def quotes_found(quotes, context_norm):
    """Quotes of more than QUOTE_MIN_CHARS characters that the normalised context contains word for word."""
    return F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: (F.length(q) > QUOTE_MIN_CHARS)
                    & F.contains(context_norm, T.quote_norm(q)))


# ---------- prepare ----------

def prepare(spark: SparkSession, cfg, runner: S.Runner) -> DataFrame:
    """Sample held-out entries, have them reworded, and label each on what is left of the corpus."""
    texts, b = _texts(cfg), cfg["transfer"]
    entries = corpus(spark, cfg)
    pool = sampling.pool(entries, b["pool_urls"], b.get("min_words", sampling.MIN_WORDS))
    held = S.land(sampling.seeded_sample(pool, b["n"], b["seed"], "id", "entry_ord"), _table(cfg, "held"))

    item = P.fill(texts["reword_item"], id=F.col("id"), title=F.col("question"), answer=F.col("answer"))
    one = held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_ord", item.alias("t")))),
                                            lambda x: x["t"]), "\n\n").alias("items"))
    reply = S.cached_calls(one.select(F.lit(cfg["grader_model"]).alias("model"), F.lit(texts["reword_system"]).alias("system"),
                                      P.fill(texts["reword"], items=F.col("items")).alias("prompt")), runner, _calls(cfg))
    emails = reply.select(F.explode(F.from_json(_object(F.col("result")), "map<string,string>")).alias("id", "email"))
    asked = lookup.lookup_strict(held, emails, "id", "email")

    removed = S.land(variants.variants(entries, held.drop("sample_ord")), _table(cfg, "held_removed"))
    corpora = held.select(F.col("entry_ord").alias("held_ord"))
    context = S.land(packing.held_contexts(entries, removed, corpora, max_bytes=_limit(cfg)), _table(cfg, "held_context"))
    asked = asked.withColumn("held_ord", F.col("entry_ord")).join(context, "held_ord")
    names = removed.join(entries.select("entry_ord", "id"), "entry_ord").groupBy("held_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", "id"))), lambda x: x["id"]).alias("removed_variants"))
    asked = asked.join(names, "held_ord")
    labelled = S.cached_calls(asked.select(
        "*", F.lit(cfg["grader_model"]).alias("model"), F.lit(texts["label_system"]).alias("system"),
        P.fill(texts["label"], context=F.col("context"), question=F.col("email"), expert=F.col("answer")).alias("prompt")),
        runner, _calls(cfg))
    label = labelled.select("*", F.from_json(_object(F.col("result")), "answerable string, quotes array<string>").alias("l"),
                            T.quote_norm(F.col("context")).alias("hay"))
    claimed = ~F.coalesce(F.col("l.answerable"), F.lit("")).isin(FALSY_JSON)
    rows = label.select(
        "sample_ord", "id", F.col("question").alias("title"), F.col("email").alias("question"),
        F.lit(QUESTION_SOURCE).alias("question_source"), F.col("answer").alias("expert"), "url", "modified",
        "removed_variants", claimed.alias("answerable_claimed"), quotes_found(F.col("l.quotes"), F.col("hay")).alias("support"))
    rows = rows.withColumn("answerable", F.col("answerable_claimed") & (F.size("support") > 0))
    S.write_rows(rows, cfg.path("out", "transfer_questions"))
    return S.load_transfer(spark, cfg.path("out", "transfer_questions"))


def _object(reply):
    """The JSON object inside a reply; a reply without one fails the job."""
    return F.coalesce(T.json_span(reply), F.raise_error(F.concat(F.lit("no JSON in reply: "), F.left(reply, F.lit(200)))).cast("string"))


# ---------- retrieval and jobs ----------

def retrieve(units: DataFrame, questions: DataFrame, vectors: DataFrame, rerank, honor_exclusions: bool = True) -> DataFrame:
    """Hybrid candidates of each question, reordered: (query_id, position, unit_ord, text, ..).

    units(unit_ord, text, hidden), questions(query_id, text, corpus_id), vectors(text_key, embedding);
    rerank(candidates, honor_exclusions) orders the fused candidates.
    """
    def with_vectors(df, *cols):
        found = df.withColumn("text_key", S.text_key(F.col("text"))).join(vectors, "text_key", "left")
        unknown = F.raise_error(F.concat(F.lit("no vector of the text: "), F.left("text", F.lit(200)))).cast("array<float>")
        return found.select(*cols, F.coalesce("embedding", unknown).alias("embedding"))

    lexical = ranking.bm25_topk(units, questions)
    dense = ranking.dense_topk(with_vectors(units, "unit_ord", "hidden"), with_vectors(questions, "query_id", "corpus_id"))
    fused = ranking.rrf([lexical, dense]).select("query_id", "unit_ord", "rank")
    bound = questions.count() * ranking.CANDIDATES
    named = packing.attach(fused, units.select("unit_ord", "text"), bound)
    asked = named.join(broadcast_if_bounded(questions.select("query_id", F.col("text").alias("question"))), "query_id")
    return rerank(asked, honor_exclusions)


def _reranker(cfg, texts, scorer, runner):
    name = cfg.get("reranker", DEFAULT_RERANKER)
    if scorer is None and name.startswith(LISTWISE_PREFIX):
        def listwise(cands, honor):
            asks = RR.listwise_requests(cands, name[len(LISTWISE_PREFIX):], texts["rerank_system"], texts["rerank"])
            return RR.rerank_listwise(cands, S.cached_calls(asks, runner, _calls(cfg)), honor)
        return listwise
    scorer = scorer or RR.cross_encoder_scorer(name)
    return lambda cands, honor: RR.rerank(cands, scorer, honor)


def _items(spark, cfg, only) -> tuple[str, DataFrame]:
    notes, cases = S.load_cases(spark, cfg.path("cases"))
    transfer = S.load_transfer(spark, cfg.path("out", "transfer_questions"))
    first = cases.count()  # transfer questions come after the written cases
    if only is not None:
        cases, transfer = lookup.only_ids(cases, only, "id"), lookup.only_ids(transfer, only, "id")
    written = cases.select(F.col("case_ord").cast("bigint").alias("item_ord"), "experiment", F.col("id").alias("case"), "question",
                           F.lit(None).cast("string").alias("held_id"), F.col("expect").cast(EXPECT).alias("expect"), "sources")
    held = transfer.select((F.col("sample_ord") + first).cast("bigint").alias("item_ord"), F.lit("transfer").alias("experiment"),
                           F.col("id").alias("case"), "question", F.col("id").alias("held_id"),
                           F.struct(F.lit(TRANSFER_DOES).alias("does"), F.lit("").alias("must_not"), F.lit("").alias("conditions"),
                                    (~F.col("answerable")).alias("clarify_ok")).cast(EXPECT).alias("expect"),
                           F.array("id").alias("sources"))
    return notes, written.unionByName(held)


def build_jobs(spark: SparkSession, cfg, make_embedder=None, scorer=None, runner=None, only=None, notes_append: str = "",
               readers=READERS, name: str = "jobs") -> DataFrame:
    """One row per item and reader: the evidence it got, the prompt, and what grading needs.

    A reads every visible entry, B packed sentence windows, C packed whole entries, O the named sources. Leave A
    out of `readers` for a corpus that no prompt can hold.
    """
    texts = _texts(cfg)
    entries = corpus(spark, cfg)
    notes, items = _items(spark, cfg, only)
    items = S.land(items, _table(cfg, "items"))
    notes += ("\n" + notes_append) if notes_append else ""
    budget, version = cfg.get("budget_words", packing.BUDGET_WORDS), cfg.get("comparator_version", 2)

    held_ids = items.where(F.col("held_id").isNotNull()).select(F.col("held_id").alias("id"))
    held_ids = held_ids.distinct()
    held = S.land(_by_id(entries, held_ids), _table(cfg, "held_entries"))
    if held.count() != held_ids.count():
        raise KeyError("a held-out question names an entry that the corpus does not have")
    removed = S.land(variants.variants(entries, held.select(*entries.columns)), _table(cfg, "removed"))
    hidden = removed.join(broadcast_if_bounded(held.select(F.col("entry_ord").alias("held_ord"), "id")), "held_ord") \
        .groupBy("entry_ord").agg(F.collect_list("id").alias("hidden"))
    questions = items.select(F.col("item_ord").alias("query_id"), F.col("question").alias("text"), F.col("held_id").alias("corpus_id"))

    def ready(units, name):
        return S.land(units.join(hidden, "entry_ord", "left"), _table(cfg, name))

    contexts = []
    retrieving = {"B": lambda: ready(packing.passage_units(entries), "passages"),
                  "C": lambda: ready(packing.answer_units(entries), "answers_units")}
    chosen = {r: make() for r, make in retrieving.items() if r in readers}
    if chosen:
        every = reduce(DataFrame.unionByName, [u.select("text") for u in chosen.values()]).unionByName(questions.select("text"))
        vectors = S.embed_texts(every, make_embedder or S.local_embedder(cfg.get("embedder", DEFAULT_EMBEDDER)),
                                cfg.path("out", "vectors"))
        order, n = _reranker(cfg, texts, scorer, runner), questions.count() * ranking.CANDIDATES
        for r, units in chosen.items():
            ranked = S.land(retrieve(units, questions, vectors, order, version >= 2), _table(cfg, f"ranked_{r}"))
            packed = packing.pack_passages(ranked, entries, n, budget, version) if r == "B" else packing.pack_answers(ranked, budget)
            contexts.append(questions.select("query_id").join(packed.select("query_id", "context"), "query_id", "left")
                            .select(F.col("query_id").alias("item_ord"), F.lit(r).alias("reader"), F.coalesce("context", F.lit("")).alias("context")))
    if "A" in readers:
        contexts.append(_full_contexts(entries, items, held, removed, _limit(cfg)))
    named = _source_texts(entries, items)
    if "O" in readers:
        contexts.append(named.where(F.col("held_id").isNull()).select("item_ord", F.lit("O").alias("reader"), F.col("strict").alias("context")))

    got = reduce(DataFrame.unionByName, contexts).join(items, "item_ord").join(named.select("item_ord", "lenient"), "item_ord")
    system = texts["answer_system"].replace("{business}", cfg.get("business", DEFAULT_BUSINESS)).replace("{escalate_to}", cfg["escalate_to"])
    place = F.array_position(F.lit(list(READERS)), F.col("reader"))
    nothing = F.array().cast("array<struct<url:string,updated:string,entry:string>>")
    jobs = got.select(
        (F.col("item_ord") * 8 + place).alias("row_ord"), "experiment", "case", "reader", F.lit(system).alias("system_prompt"),
        P.fill(texts["answer"], notes=F.lit(notes), context=F.col("context"), question=F.col("question")).alias("prompt"),
        T.nwords(F.col("context")).alias("context_words"),
        F.when(F.col("reader") == "A", nothing).otherwise(T.header_fields(F.col("context"))).alias("received"),
        "question", "expect", F.col("lenient").alias("sources"))
    return S.land(jobs, _table(cfg, name))


def _full_contexts(entries, items, held, removed, limit) -> DataFrame:
    """Reader A: one text for all items that see the whole corpus, one per held entry."""
    keyed = items.join(held.select(F.col("id").alias("held_id"), F.col("entry_ord").alias("held_ord")), "held_id", "left")
    keyed = keyed.select("item_ord", F.coalesce("held_ord", F.lit(-1)).alias("held_ord"))
    context = packing.held_contexts(entries, removed, keyed, max_bytes=limit)
    return keyed.join(context, "held_ord").select("item_ord", F.lit("A").alias("reader"), "context")


def _source_texts(entries, items) -> DataFrame:
    """The named sources of each item: lenient (an unknown id prints as itself) and, for written cases, strict."""
    named = items.select("item_ord", "held_id", F.posexplode("sources").alias("i", "id"))
    found = _by_id(entries, named).select("id", T.entry_text(F.col("url"), F.col("modified"), F.col("question"), F.col("answer")).alias("text"))
    named = named.join(found, "id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown source id: "), "id")).cast("string")
    strict = F.when(F.col("held_id").isNull(), F.coalesce("text", unknown))

    def joined(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("t")))), lambda x: x["t"]), "\n\n")

    texts = named.groupBy("item_ord").agg(joined(F.coalesce("text", "id")).alias("lenient"), joined(strict).alias("strict"))
    return items.select("item_ord", "held_id").join(texts, "item_ord", "left").fillna("", ["lenient", "strict"])


# ---------- answer, grade, regrade, intervene ----------

def _answered(cfg, jobs, runner, name: str = "answers") -> DataFrame:
    asks = jobs.select("*", F.lit(cfg["answer_model"]).alias("model"), F.col("system_prompt").alias("system"))
    got = S.cached_calls(asks, runner, _calls(cfg))
    return S.land(got.select("row_ord", "experiment", "case", "reader", "context_words", "received", "question", "expect", "sources",
                             F.col("result").alias("answer"), "usage", F.col("key").alias("answer_call")), _table(cfg, name))


def _graded(cfg, answered, runner, site=None, notes="") -> DataFrame:
    texts = _texts(cfg)
    context = F.col("site") if site is not None else None
    rows = answered if site is None else answered.withColumn("c", F.lit(0)).join(F.broadcast(site), "c")
    prompt = P.grader_prompt(texts, F.col("question"), F.col("expect"), F.col("sources"), F.col("answer"), context, F.lit(notes))
    asks = rows.select(*answered.columns, F.lit(cfg["grader_model"]).alias("model"), F.lit(texts["grader_system"]).alias("system"),
                       prompt.alias("prompt"))
    got = S.cached_calls(asks, runner, _calls(cfg)).drop("usage") if "usage" not in answered.columns else \
        S.cached_calls(asks.withColumnRenamed("usage", "answer_usage"), runner, _calls(cfg)).drop("usage").withColumnRenamed("answer_usage", "usage")
    graded = got.withColumn("g", grading.parse_grade("result")).withColumn("grade_call", F.col("key"))
    return graded.select("row_ord", "experiment", "case", "reader", "context_words", "received", "answer",
                         *(["usage"] if "usage" in answered.columns else []), "answer_call", "grade_call", "g.*",
                         grading.success(F.col("g.outcome"), F.col("expect.clarify_ok")).alias("success"))


def _site(cfg, entries) -> DataFrame:
    """The whole corpus as one row, measured before it is built."""
    return packing.full_context(entries.withColumn("c", F.lit(0)), "c", max_bytes=_limit(cfg)).select("c", F.col("context").alias("site"))


def run(spark: SparkSession, cfg, runner, make_embedder=None, scorer=None, readers=READERS) -> DataFrame:
    jobs = build_jobs(spark, cfg, make_embedder, scorer, runner, readers=readers)
    S.write_rows(_graded(cfg, _answered(cfg, jobs, runner), runner), cfg.path("out", "graded"))
    return read_graded(spark, cfg)


def read_graded(spark: SparkSession, cfg, src: str = "graded", extra: str = "") -> DataFrame:
    return S.read_rows(spark, cfg.path("out", src), GRADED_SCHEMA + extra, "row_ord")


def regrade(spark: SparkSession, cfg, runner, make_embedder=None, scorer=None, src="graded", dst="graded_site",
            readers=READERS) -> DataFrame:
    """Grade the same replies again with the whole site in view; the first grading stays as it is.

    What grading needs of a job are its question, expectation and sources, so nothing is retrieved, embedded or packed; `make_embedder` and
    `scorer` are accepted as in `run` and not used.
    """
    entries = corpus(spark, cfg)
    notes, items = _items(spark, cfg, None)
    items = S.land(items, _table(cfg, "regrade_items"))
    named = _source_texts(entries, items).select("item_ord", F.col("lenient").alias("sources"))
    jobs = items.drop("sources").join(named, "item_ord").select("experiment", "case", "question", "expect", "sources", "held_id")
    rows = read_graded(spark, cfg, src).drop("grade_call", "outcome", "evidence", "keeps", "loses", "extras", "success")
    asked = F.col("reader").isin(list(readers)) & ((F.col("reader") != "O") | F.col("held_id").isNull())
    again = rows.join(jobs, ["experiment", "case"]).where(asked).drop("held_id")
    if again.select("row_ord").distinct().count() != rows.count():
        raise KeyError("graded rows without a matching job")
    out = _graded(cfg, again, runner, _site(cfg, entries), notes)
    S.write_rows(out.withColumn("graded_with", F.lit(GRADED_WITH_SITE)), cfg.path("out", dst))
    return read_graded(spark, cfg, dst, ", graded_with string")


def intervene(spark: SparkSession, cfg, runner, make_embedder=None, scorer=None, readers=READERS) -> DataFrame:
    """Rerun the listed cases with one line appended to the source notes; other results stay untouched."""
    iv = cfg["intervention"]
    jobs = build_jobs(spark, cfg, make_embedder, scorer, runner, only=set(iv["cases"]), notes_append=iv["notes_append"], readers=readers,
                      name="intervention_jobs")
    notes = S.load_cases(spark, cfg.path("cases"))[0] + "\n" + iv["notes_append"]
    entries = spark.read.parquet(_table(cfg, "entries"))
    out = _graded(cfg, _answered(cfg, jobs, runner, "intervention_answers").drop("usage"), runner, _site(cfg, entries), notes)
    S.write_rows(out.withColumn("intervention", F.lit(iv["notes_append"])), cfg.path("out", "graded_intervention"))
    return read_graded(spark, cfg, "graded_intervention", ", intervention string")


def report(spark: SparkSession, cfg, src: str = "graded") -> tuple[DataFrame, DataFrame]:
    """(summary, paired) counts of a grading, also written under the matching results name."""
    rows = read_graded(spark, cfg, src)
    name = src.replace("graded", "results")
    summary, pairs = grading.outcome_summary(rows), grading.paired(rows)
    S.write_rows(summary, cfg.path("out", name, "summary"))
    S.write_rows(pairs, cfg.path("out", name, "paired"))
    return summary, pairs
