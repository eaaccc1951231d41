"""Pages to question/answer entries, and the check of entries against the displayed pages."""
from __future__ import annotations

import html
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import text as T

# The markup that carries question/answer blocks.
BLOCK_MARKER = "schema-faq-question"
SECTION = r'(?s)<div class="schema-faq-section" id="[^"]+">.*?</div>'
SECTION_ID = r'^<div class="schema-faq-section" id="([^"]+)">'
QUESTION_AND_REST = r'(?s)^.*?<strong class="schema-faq-question">(.*?)</strong>(.*)</div>$'

# entry_ord = page_ord * 2^16 + section position; unit_ord = entry_ord * 2^18 + window position: 536 million pages of 65,536
# sections of 262,144 windows. What does not fit is refused, never wrapped.
SECTION_BITS, WINDOW_BITS = 16, 18


def pack_ordinal(outer: Column, inner: Column, bits: int) -> Column:
    """One sortable bigint from two ordinals; refuses inner positions that would spill over and outer ones that would wrap."""
    fits = (inner < (1 << bits)) & F.coalesce(outer, F.lit(0)).between(0, (1 << (63 - bits)) - 1)
    return (F.when(fits, F.shiftleft(outer.cast("bigint"), bits) + inner.cast("bigint"))
            .otherwise(F.raise_error(F.lit(f"ordinal exceeds {bits} bits")).cast("bigint")))


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [html.unescape(x) for x in xs], na_action="ignore")


@F.pandas_udf(ArrayType(IntegerType()))
def _occurrences(s: pd.Series) -> pd.Series:
    """For each value of a list, how often it has come by then; lists without repeats are not sent here."""
    def numbered(values):
        seen: dict[str, int] = {}
        out = []
        for v in values:
            seen[v] = seen.get(v, 0) + 1
            out.append(seen[v])
        return out
    return s.map(numbered, na_action="ignore")


def extract_entries(pages: DataFrame) -> DataFrame:
    """pages(page_ord, id, link, modified, content.rendered) -> one row per non-empty question/answer block.

    A page is handled within its own row: sections, cleaning and the repeat suffix are array expressions, so
    the whole extraction is a scan plus a generator and never shuffles page text.
    """
    body = F.col("content.rendered")
    found = (pages.where(F.contains(body, F.lit(BLOCK_MARKER)))
             .select("page_ord", F.col("id").cast("string").alias("page"), F.col("link").alias("url"), "modified",
                     F.regexp_extract_all(body, F.lit(SECTION), F.lit(0)).alias("s"))
             .where(F.size("s") > 0))

    def raw(group: int) -> Column:
        return F.transform("s", lambda x: F.regexp_replace(F.regexp_replace(
            F.regexp_extract(x, QUESTION_AND_REST, group), T.LINE_BREAK_TAGS, "\n"), T.ANY_TAG, ""))

    def decoded(c: Column) -> Column:
        return F.coalesce(_unescape_all(F.when(F.exists(c, lambda x: F.contains(x, F.lit("&"))), c)), c)

    def tidy(c: Column) -> Column:
        return F.transform(c, lambda t: F.array_join(F.filter(F.transform(
            F.split(F.regexp_replace(t, T.INLINE_SPACE, " "), "\n"), T.strip), lambda ln: ln != ""), "\n"))

    keep = ("page_ord", "page", "url", "modified")
    parts = found.select(*keep, F.transform("s", lambda x: F.regexp_extract(x, SECTION_ID, 1)).alias("block"),
                         raw(1).alias("q"), raw(2).alias("a"))
    parts = parts.select(*keep, "block", decoded(F.col("q")).alias("q"), decoded(F.col("a")).alias("a"))
    zipped = parts.select(*keep, F.arrays_zip(
        F.sequence(F.lit(0), F.size("block") - 1).alias("pos"), F.col("block"),
        tidy(F.col("q")).alias("question"), tidy(F.col("a")).alias("answer")).alias("e"))
    kept = zipped.select(*keep, F.filter("e", lambda x: (x["question"] != "") & (x["answer"] != "")).alias("e"))
    blocks = F.transform("e", lambda x: x["block"])
    repeated = F.when(F.size(F.array_distinct(blocks)) < F.size(blocks), blocks)
    counted = kept.select(*keep, "e", _occurrences(repeated).alias("nth"))
    zipped = F.transform("e", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("nth", i), F.lit(1)).alias("nth")))
    rows = counted.select(*keep, F.posexplode_outer(zipped).alias("i", "e")).where(F.col("i").isNotNull())
    suffix = F.when(F.col("e.nth") > 1, F.concat(F.lit("#"), F.col("e.nth").cast("string"))).otherwise("")
    return rows.select(pack_ordinal(F.col("page_ord"), F.col("e.x.pos"), SECTION_BITS).alias("entry_ord"), F.concat("page", F.lit(":"), "e.x.block", suffix).alias("id"),
                       "url", "modified", F.col("e.x.block").alias("block"), F.col("e.x.question").alias("question"), F.col("e.x.answer").alias("answer"))


def exclude_urls(entries: DataFrame, urls: Iterable[str]) -> DataFrame:
    """Drop entries of the (configured, hence short) list of URLs; exact match."""
    urls = sorted(set(urls))
    return entries.where(~F.col("url").isin(urls)) if urls else entries


def check_entries(entries: DataFrame, displayed: DataFrame, page: str = "url") -> DataFrame:
    """Per entry: is its whole answer in the displayed text of its page?  displayed(page, html), one row per page.

    `page` names the column of both sides that tells pages apart: the url where each url was fetched once, another key where a url has several pages.
    An entry whose page was not fetched, or was given twice, fails the job instead of being reported as found or missing.
    """
    named = F.col(page).cast("string")
    twice = F.raise_error(F.concat(F.lit("page given twice: "), named)).cast("string")
    shown = (displayed.select(page, T.visible_text(F.col("html")).alias("shown")).groupBy(page).agg(F.first("shown").alias("shown"), F.count("*").alias("n"))
             .select(page, F.when(F.col("n") > 1, twice).otherwise(F.col("shown")).alias("shown")))
    wanted = entries.select("entry_ord", "id", "url", *{page} - {"url"}, T.display_norm(F.col("answer")).alias("wanted"))
    joined = wanted.join(shown, page, "left")
    there = F.when(F.col("shown").isNull(), F.raise_error(F.concat(F.lit("page not fetched: "), named)).cast("boolean")) \
        .otherwise(F.contains("shown", F.col("wanted")))
    return joined.select("entry_ord", "id", "url", (~there).alias("missing"))


def check_summary(checked: DataFrame) -> DataFrame:
    """Per url counts. The missing ids stay rows (`checked.where('missing')`): a url may hold very many."""
    return checked.groupBy("url").agg(F.count("*").alias("entries"), F.count_if("missing").alias("n_missing"))
