"""Text operators: tokens, word counts, sentences, overlapping windows, shingles and the normalisers.

Column functions stay on the JVM. The row-multiplying ones take and return DataFrames: the split array is
materialised once per row below a generator, so no regex is re-evaluated per element. Generators over computed
arrays are outer ones throughout the package: for a plain explode the optimizer infers a size filter, pushes it
below and so evaluates the array (per element, where a lambda holds it) a second time.
"""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and formats whose exact form decides the results.
TOKEN = "[a-z0-9]+"
SENTENCE_END = ".!?"
SENTENCE_START = "A-Z0-9\"'("
LINE_BREAK_TAGS = r"</p>|<br\s*/?>"
ANY_TAG = "<[^>]+>"
SCRIPT_OR_STYLE = r"(?is)<(script|style)[^>]*>.*?</\1>"
INLINE_SPACE = r"[ \t\x{a0}]+"
HEADER = ("[", " | page updated ", " | entry: ", "]")
HEADER_LINE = r"(?dm)^\[([^%s]+) \| page updated ([^%s]+) \| entry: (.*)\]$"
WINDOW_SIZE, WINDOW_STRIDE = 3, 2
CHUNK_SIZE, CHUNK_OVERLAP = 200, 40
SHINGLE_WORDS = 8

# Every character that Python's str.split()/strip() treats as white space; Java's \s is ASCII only.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Printable ASCII is settled by the first test of the class, which is what most text consists of.
SPACE_RUN = f"[[^!-~]&&[{SPACE}]]+"
WORD_RUN = f"[!-~[^{SPACE}]]+"
SPACE_NO_NEWLINE = SPACE.replace(r"\t-\r", r"\t\x0b-\r")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE_RUN, " "))


def words(c: Column) -> Column:
    """Lower-case ASCII alphanumeric runs; accented letters end a token."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def nwords(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RUN))


def split_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_RUN), F.lit(0))


def sentences(c: Column) -> Column:
    """Break at newlines and after . ! ? when a capital, digit, quote or bracket follows."""
    parts = F.split(c, rf"\n|(?<=[{SENTENCE_END}])[[^!-~]&&[{SPACE_NO_NEWLINE}]]+(?=[{SENTENCE_START}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML character references. Only rows that contain '&' travel to Python; the others stay put."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def clean(c: Column) -> Column:
    """Markup fragment to text: breaks become newlines, tags vanish, blank lines are dropped."""
    flat = unescape(F.regexp_replace(F.regexp_replace(c, LINE_BREAK_TAGS, "\n"), ANY_TAG, ""))
    lines = F.transform(F.split(F.regexp_replace(flat, INLINE_SPACE, " "), "\n"), strip)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def display_norm(c: Column) -> Column:
    """Comparison form of displayed text: references decoded, straight quotes, single spaces, lower case."""
    return F.lower(collapse(F.translate(unescape(c), "\u2019\u2018\u201c\u201d", "''\"\"")))


def visible_text(c: Column) -> Column:
    return display_norm(F.regexp_replace(F.regexp_replace(c, SCRIPT_OR_STYLE, " "), ANY_TAG, " "))


def quote_norm(c: Column) -> Column:
    """Comparison form of model quotes: only the right single quote is straightened, nothing is decoded."""
    return F.lower(collapse(F.translate(c, "\u2019", "'")))


def header(url: Column, modified: Column, question: Column) -> Column:
    a, b, c, d = map(F.lit, HEADER)
    return F.concat(a, url, b, F.substring(modified, 1, 10), c, question, d)


def entry_text(url: Column, modified: Column, question: Column, answer: Column) -> Column:
    return F.concat(header(url, modified, question), F.lit("\n"), answer)


def header_fields(c: Column) -> Column:
    """All header lines of a context as array<struct<url,updated,entry>>."""
    pattern = F.lit(HEADER_LINE % (SPACE, SPACE))
    found = [F.regexp_extract_all(c, pattern, F.lit(i)) for i in (1, 2, 3)]
    return F.arrays_zip(*(f.alias(n) for f, n in zip(found, ("url", "updated", "entry"))))


def json_span(c: Column) -> Column:
    """First '{' to last '}', or NULL when there is none."""
    hit = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(hit != "", hit)


def _starts(n: Column, size: int, step: int, stop: Column) -> Column:
    """Zero-based slice starts: one for short inputs, else 0, step, .. below `stop`."""
    return (F.when(n == 0, F.array().cast("array<int>"))
            .when(n <= size, F.array(F.lit(0)))
            .otherwise(F.sequence(F.lit(0), F.least(stop, n) - 1, F.lit(step))))


def _slices(df: DataFrame, parts: Column, size: int, step: int, stop, out: str, ordinal: str, keep) -> DataFrame:
    """The slices are made in the row, so the generator copies none of the other parts of a long text with each of them."""
    every = named(parts, lambda p: F.transform(_starts(F.size(p), size, step, stop(F.size(p))), lambda at: F.array_join(F.slice(p, at + 1, size), " ")))
    return df.select(*keep, F.posexplode_outer(every).alias(ordinal, out)).where(F.col(ordinal).isNotNull())


def window_rows(df: DataFrame, text: str, *keep: str, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE,
                out: str = "window", ordinal: str = "k") -> DataFrame:
    """Overlapping sentence windows, one row each."""
    return _slices(df, sentences(F.col(text)), size, stride, lambda n: n - size + stride, out, ordinal, keep)


def chunk_rows(df: DataFrame, text: str, *keep: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               out: str = "chunk", ordinal: str = "k") -> DataFrame:
    """Fixed-size word chunks sharing `overlap` words with the next one."""
    return _slices(df, split_words(F.col(text)), size, size - overlap, lambda n: n - overlap, out, ordinal, keep)


def shingle_sets(df: DataFrame, text: str, *keep: str, n: int = SHINGLE_WORDS, out: str = "shingles") -> DataFrame:
    """Distinct n-token shingles per row. Tokens hold no spaces, so the joined string identifies the shingle."""
    listed = df.select(*keep, words(F.col(text)).alias("_toks"))
    size = F.size("_toks")
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                                          lambda i: F.array_join(F.slice("_toks", i, n), " ")))
    return listed.select(*keep, F.coalesce(F.array_distinct(grams), F.array().cast("array<string>")).alias(out))


def named(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the distinct tokens of two texts; 0 where either has none."""
    def of(x, y):
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))
    return named(F.array_distinct(words(a)), lambda x: named(F.array_distinct(words(b)), lambda y: of(x, y)))


def shingles(c: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct n-token shingles of a text."""
    def of(t):
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))
    return named(words(c), of)


def containment(a: Column, b: Column, n: int = SHINGLE_WORDS) -> Column:
    """Share of a's distinct shingles that b has; 0 where a has none."""
    return named(shingles(a, n), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, shingles(b, n))) / F.size(x)).otherwise(F.lit(0.0)))
