"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Every rule is a ratio of a document's counts and rejects above a cutoff. Labelled documents are the holdout: in each stratum (lang) the rules are taken in turn,
by the bad documents they catch, and what they reject together is tested at RISK, by the exact binomial tail of the good documents that were rejected. So with
probability 1 - CONFIDENCE no stratum loses more than RISK of its good documents. A rule without a cutoff never rejects in that stratum.

Only cutoffs at which a rule catches further bad documents are candidates; which ones these are and the order depend on bad documents alone, so the good ones are
still a fresh sample. Rejections grow with tightening, so a false refutation of any choice is one of a loosest choice that is too tight too. Choices of which none is
looser than another are at most the product of the rules' numbers of choices, divided by the largest. So rule j is tested at CONFIDENCE / (rules * strata * that number
over the first j rules), which is 1 for the first rule: with four languages 297 good documents of which none is rejected give it a cutoff. Strata whose good
labels could never give one are not counted.

`cutoffs` is the plain alternative: each rule bounded by RISK / rules on its own, with Bonferroni over all rules, cutoffs and strata.

Defined results: words are split by ASCII white space; a null text has no words and fails the base; null languages are a stratum of their own;
labels of one document that contradict each other count as good; labels other than 0 and 1 and labels without a document are ignored;
repeated rows stay; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_enough, written

RISK = 0.02
CONFIDENCE = 0.05
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CUTOFFS = [0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0]
#: rule: ratio of the counts
RULES = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
    "marks": "n_marks / n_words",
}


def bound(expression: str, name: str, body: str) -> str:
    """`body` with the value of `expression` named: evaluated once, however often the body uses it."""
    return f"element_at(transform(array({expression}), {name} -> {body}), 1)"


def repeat_words(words: str) -> str:
    """How many words lie in a 3-word window that the array holds twice or more.

    Windows as (hash, position) in order; equal neighbours are repeats; their positions in order cover up to three words each.
    """
    grams = f"transform(arrays_zip(slice({words}, 1, size({words})), slice({words}, 2, size({words})), slice({words}, 3, size({words}))), " \
            "(x, i) -> struct(xxhash64(x['0'], x['1'], x['2']) as h, i as i))"
    ordered = f"array_sort(slice({grams}, 1, size({words}) - 2))"
    doubled = bound(ordered, "o", "filter(o, (x, k) -> coalesce(get(o, k - 1).h = x.h, false) or coalesce(get(o, k + 1).h = x.h, false))")
    places = f"array_sort(transform({doubled}, x -> x.i))"
    covered = bound(places, "p", "aggregate(arrays_zip(slice(p, 1, size(p)), slice(p, 2, size(p))), 0L, (n, x) -> n + least(3, coalesce(x['1'] - x['0'], 3)))")
    return f"if(size({words}) < 4, 0L, {covered})"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c) for c in keep], text.alias("_text"))
    removed = lambda chars: F.char_length("_text") - F.char_length(F.translate("_text", chars, ""))
    split = r"array_remove(split(_text, '[\\x20\\x09-\\x0D]+'), '')"
    lines = f"filter(split(_text, '\\n'), l -> translate(l, '{SPACES}', '') <> '')".replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return rows.select(
        *keep,
        F.expr(bound(split, "w", f"struct(cast(size(w) as long) as n_words, {repeat_words('w')} as n_repeat_words)")).alias("_w"),
        F.expr(bound(lines, "l", "struct(cast(size(l) as long) as n_lines, cast(size(l) - size(array_distinct(l)) as long) as n_dup_lines)")).alias("_l"),
        (F.char_length("_text") - removed(SPACES)).cast("long").alias("word_chars"), removed(SYMBOLS).cast("long").alias("n_symbols"),
        removed(CAPITALS).cast("long").alias("n_capitals"), removed("!?").cast("long").alias("n_marks"),
    ).select(*keep, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_capitals", "n_marks") \
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def stratum():
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def tail(n: str, k: str, risk: float) -> str:
    """ln of the probability of at most `k` rejections among `n` if each had probability `risk`; 0 (not small) from the mean on.

    Terms from 0 to k, each from the one before, summed in logarithms.
    """
    from math import log, log1p

    first, step = f"{n} * {log1p(-risk)!r}", f"{log(risk) - log1p(-risk)!r}"
    add = f"transform(array(s.t + ln(({n} - i + 1) / i) + ({step})), t -> struct(t as t, greatest(t, s.s) + ln(1 + exp(-abs(t - s.s))) as s))"
    return (f"if({k} >= {n} * {risk!r}, 0D, aggregate(if({k} < 1, array(), sequence(1L, {k})), struct(cast({first} as double) as t, cast({first} as double) as s), "
            f"(s, i) -> element_at({add}, 1)).s)")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, one column a rule): the chosen cutoffs, null where a rule has none."""
    labelled = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    rows = measured.where("not base_failed").join(labelled, "doc_id")
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.expr(e.replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0)).alias("value"))
                                 for r, e in RULES.items()]))
    # level: how many cutoffs the value exceeds; one row a stratum, rule and level is left
    counted = (rows.select(stratum().alias("stratum"), "good", values.alias("v")).select("stratum", "good", "v.rule", "v.value")
               .groupBy("stratum", "rule", F.size(F.filter(grid, lambda c: F.col("value") > c)).alias("level"))
               .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    every = (counted.select("stratum", "rule").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS)))))
             .join(counted, ["stratum", "rule", "level"], "left").fillna(0, ["good", "bad"]))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    whole = Window.partitionBy("stratum", "rule")
    tried = every.select("stratum", "rule", "level", F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("caught"),
                         F.sum("good").over(whole).alias("n")).where("level > 0")
    tests = F.lit(len(RULES) * len(CUTOFFS)) * F.lit(max(1, measured.select(stratum().alias("s")).distinct().count()))
    sure = tried.where("caught > 0").where(F.expr(tail("n", "k", risk / len(RULES))) <= F.log(F.lit(confidence) / tests))
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct("caught", "level")).alias("best")).withColumn("cutoff", F.element_at(grid, F.col("best.level")))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select("stratum", *[F.col(r).cast("double").alias(f"max_{r}") for r in RULES])


def joint_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """As `cutoffs`, but `risk` bounds what all rules of a stratum reject together."""
    from math import log, log1p

    labelled = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    grid, never = F.array(*[F.lit(c) for c in CUTOFFS]), len(CUTOFFS) + 1
    values = F.array(*[F.coalesce(F.expr(e.replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0)) for e in RULES.values()])
    # how many cutoffs each rule's value exceeds; a row for each such list in a stratum
    rows = written(measured.where("not base_failed").join(labelled, "doc_id").select(stratum().alias("stratum"), "good", values.alias("v"))
                   .select("stratum", "good", F.transform("v", lambda v: F.size(F.filter(grid, lambda c: v > c))).alias("levels"))
                   .groupBy("stratum", "levels").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "labelled")
    caught = (rows.where("bad > 0").select("stratum", "bad", F.posexplode("levels").alias("rule", "level")).where("level > 0")
              .groupBy("stratum", "rule").agg(F.sum("bad").alias("caught"), (1 + F.count_distinct("level")).alias("choices")))
    order = caught.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct((-F.col("caught")).alias("c"), "rule", "choices"))).alias("turns"))
    sizes = rows.groupBy("stratum").agg(F.sum("good").alias("n")).where(F.col("n") >= log(confidence / len(RULES)) / log1p(-risk))
    state = written(order.join(sizes, "stratum").withColumn("limits", F.array_repeat(F.lit(never), len(RULES))), "turns")
    strata = max(1, state.count())
    for j in range(len(RULES)):
        turn = state.where(F.size("turns") > j).withColumn("rule", F.expr(f"turns[{j}].rule"))
        width = f"aggregate(slice(turns, 1, {j + 1}), 1D, (a, x) -> a * x.choices) / array_max(transform(slice(turns, 1, {j + 1}), x -> x.choices))"
        gone = "exists(zip_with(levels, limits, (l, t) -> l >= t), x -> x)"  # by the rules before
        every = (rows.join(turn.withColumn("enough", F.log(F.lit(confidence / len(RULES) / strata)) - F.log(F.expr(width))), "stratum")
                 .withColumn("level", F.expr(f"if({gone}, {never}, levels[rule])"))
                 .groupBy("stratum", "n", "enough", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        tried = every.withColumn("k", F.sum("good").over(Window.partitionBy("stratum").orderBy(F.desc("level"))))
        sure = tried.where(f"bad > 0 and level between 1 and {never - 1}").where(F.expr(tail("n", "k", risk)) <= F.col("enough"))
        best = sure.groupBy("stratum").agg(F.min("level").alias("level"))  # catches most, and each tighter level catches more
        state = written(state.join(best, "stratum", "left").withColumn("limits", F.expr(
            f"transform(limits, (t, i) -> if(i = get(turns, {j}).rule and level is not null, level, t))")).drop("level"), "turns")
    return state.select("stratum", *[F.get(grid, F.expr(f"limits[{i}] - 1")).cast("double").alias(f"max_{r}") for i, r in enumerate(RULES)])


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """`measured` with `kept`."""
    rejects = F.lit(False)
    for rule, ratio in RULES.items():
        rejects = rejects | F.coalesce(F.expr(ratio.replace(" / ", " / nullif(") + ", 0)") > F.col(f"max_{rule}"), F.lit(False))
    limits = F.broadcast(limits) if small_enough(limits, 100_000) else limits  # a row a stratum
    return (measured.withColumn("stratum", stratum()).join(limits, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejects)
            .drop("stratum", *[f"max_{r}" for r in RULES]))


def rate(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    measured = written(measures(source, "doc_id", "lang"), "measures")
    limits = written(joint_cutoffs(measured, labels, risk, confidence), "cutoffs")
    return judged(measured, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents that are kept, with all their columns: labelled ones are measured for the cutoffs, and all are measured once where they are read."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    ids = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    holdout = source.join(F.broadcast(ids) if small_enough(ids) else ids, "doc_id", "left_semi")
    limits = written(joint_cutoffs(written(measures(holdout, "doc_id", "lang"), "measures"), labels, risk, confidence), "cutoffs")
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "lang", "text")
    return judged(measures(whole, "_row", "lang"), limits).where("kept").select("_row.*")
