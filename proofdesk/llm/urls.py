"""Judging urls by a trie of allow and block rules over reversed host labels and path segments.

A rule names a host (and with it all its subdomains) and the beginning of a path. Host labels are walked from the last to the first, path
segments from the first on; the last segment of a rule may stop within a segment of the url. The longest rule that fits decides: most
characters in host and path together, then the block entry. A url that no rule fits is `fallback`.

Defined results: a null url, or one without `://`, has an empty host and path and gets the fallback; host labels may be empty; nothing is
unescaped; repeated rows stay; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

PART_BYTES = 64 << 20


class RuleTrie:
    """Nested dicts: host labels from the right, below "/path" whole path segments, and at "/ends" the rules that end there.

    Labels and segments hold no slash, so the two keys are free.
    """

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/path", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault("/ends", []).append((rest, len(host) + len(path), verdict, host + path))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get("/path")
            for segment in segments:
                if below is None:
                    break
                for rest, size, verdict, rule in below.get("/ends", ()):
                    if segment.startswith(rest) and (best is None or (size, verdict) > best[:2]):
                        best = (size, verdict, rule)
                below = below.get(segment)
        return best and (best[2], best[1])


def rule_parts(rules, most: int) -> list[list]:
    """The rules in order, in parts of at most `most` bytes; a longer rule is a part of its own."""
    parts, size = [[]], 0
    for verdict, host, path in rules:
        own = len(host.encode()) + len(path.encode())
        if parts[-1] and size + own > most:
            parts.append([])
            size = 0
        parts[-1].append((verdict, host, path))
        size += own
    return parts


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], fallback: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; `rules` are (allow or block, host, path).

    A trie of at most PART_BYTES of rules is sent to the executors. More rules make several tries, which judge one after the other; the longest fit of all decides.
    """

    def with_trie(frame, trie):
        sent = frame.sparkSession.sparkContext.broadcast(trie)

        def run(batches):
            judge = sent.value.judge
            for batch in batches:
                best = []
                for host, path, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict"))):
                    found = judge(host, path)
                    best.append(found if found and (rule is None or (len(found[0]), found[1]) > (len(rule), verdict)) else (rule, verdict))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.string())],
                    ["page_id", "host", "path", "rule", "verdict"])

        return frame.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")

    # the part behind the first "://"; \z and (?s) keep line breaks inside it
    behind = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("behind", r"(?s)\A([^/?#]*)", 1)
    none = F.lit(None).cast("string")
    judged = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(behind, F.lit("")).alias("behind"))
              .select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                      F.regexp_extract("behind", r"(?s)\A[^/?#]*([^?#]*)", 1).alias("path"), none.alias("rule"), none.alias("verdict")))
    for at, part in enumerate(rule_parts(rules, PART_BYTES)):
        judged = with_trie(written(judged, "judged") if at else judged, RuleTrie(part))  # one trie in a task at a time
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(fallback)))
