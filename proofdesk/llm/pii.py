"""Personal data: exact formats first, then spans that boosted trees accept among overlapping candidates.

Four kinds (`KINDS`) have a base: formats that are matched from left to right and checked (parts up to 255, Luhn, number of digits). Base spans always count. What the
formats miss is proposed by generators of high recall: stretches of digit groups from each group to each later one, spelled-out or
bracketed addresses, spaced or bracketed dots. Candidates overlap freely. Gradient-boosted trees score each one by its format (digits, groups, separators, Luhn) and its
context (neighbouring characters and cue words), and those above a calibrated threshold are taken, best first, without overlaps.

Labels are made from the corpus itself, from all documents that may hold anything. A candidate that is a base span is
positive; one that partly overlaps a base span, or is a well-formed number that failed its check, or touches no match at all is negative; what lies in a match that
failed by its length only is left out, as it may hide data. Each base span is also set into its context in disguise and beside another number, where the formats fail,
with known places. A third of the documents, by hash, is not fitted on: from them each kind gets the lowest threshold whose precision is above
PRECISION by the exact binomial bound at CONFIDENCE. A kind without enough of them adds nothing.

Nothing is sampled. Equal examples are one row with their number, feature values are counted for exact quantiles, and a tree needs only sums by node, feature and bin.
These are whole numbers, so they do not depend on how rows are dealt: the tasks make them from the table of binned examples, or the driver where that table was measured small.

Defined results: offsets are code points, ends exclusive; a null or empty text has no spans; repeated rows are judged each; rows without an id are not learnt from; an empty table
gives no rows; further columns are not read. Time is linear in the text, but for numbers of up to MOST_GROUPS groups, each of whose stretches is a candidate.
"""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, small_enough, texts, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL_ROWS = 100_000  # distinct binned examples that one process sums up; more are summed up by the tasks
PRECISION, CONFIDENCE = 0.95, 0.95
MOST_GROUPS = 8
TREES, DEPTH, RATE, BINS, RIDGE = 40, 4, 0.25, 32, 1.0
STEPS = (0.99, 0.98, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)
UNIT = 1 << 24  # gradients and curvatures are rounded to its parts, so that sums are exact in any order
SLICE = 4 << 20

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP_FORM = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_FORM = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_FORM = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What a text must hold to have any span or candidate.
HOT = r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]| [dD][oO][tT] "
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9])*+")
GROUP = re.compile(r"[0-9]+")
AT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| at )"
DOT = r"(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )"
SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}", re.I)
SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]? ?\. ?[\])]? ?[0-9]{1,3}){3}(?![0-9])")
CUES = {EMAIL: {"mail", "email", "e-mail", "contact", "write", "correo", "courriel"}, IP: {"ip", "host", "server", "address", "adresse"},
        CARD: {"card", "credit", "visa", "karte", "carte", "tarjeta"}, PHONE: {"tel", "phone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}}
LAST_WORD = re.compile(r"([^\W\d_][\w-]*)\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def email_matches(text: str):
    """Leftmost matches of the address format, in linear time: each @ is looked at once."""
    for run in LOCAL_RUN.finditer(text) if "@" in text else ():
        at, stop = run.start(), run.end()
        begin = at  # where the next name may begin
        while (at := text.find("@", at, stop)) >= 0:
            domain = DOMAIN.match(text, at + 1, stop) if at > begin else None
            if domain:
                yield begin, domain.end()
                at = begin = domain.end()
            else:
                at += 1
                begin = at


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in GROUP.findall(text))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """((start, kind, end) of the base, (start, kind, end, well formed) of the matches that failed their check), the base in order."""
    found, failed = [(a, EMAIL, b) for a, b in email_matches(text)], []
    for kind, form in ((IP, IP_FORM), (CARD, CARD_FORM), (PHONE, PHONE_FORM)):
        for m in form.finditer(text) if kind != PHONE or "+" in text else ():
            n = len(digits_of(m[0]))
            sized = kind == IP or (14 <= n <= 19 if kind == CARD else 10 <= n <= 15)
            if sized and (kind == PHONE or (small_parts(m[0]) if kind == IP else luhn(digits_of(m[0])))):
                found.append((m.start(), kind, m.end()))
            elif kind == IP or n >= 10:
                failed.append((m.start(), kind, m.end(), sized))
    return sorted(found), failed


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that might be personal data; they overlap."""
    out = set()
    for m in NUMBERS.finditer(text):
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            total = 0
            for j in range(i, min(len(groups), i + MOST_GROUPS)):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                if total >= 13:
                    out.add((a, CARD, groups[j][1]))
                if 7 <= total <= 15:
                    begin = a
                    while begin > m.start() and text[begin - 1] in "+(":
                        begin -= 1
                    out.update((b, PHONE, groups[j][1]) for b in {a, begin})
    out.update((m.start(), IP, m.end()) for m in SPACED_IP.finditer(text))
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        out.update((m.start(), EMAIL, m.end()) for m in SPELLED.finditer(text))
    return sorted(out)


def kind_of(c: str) -> int:
    """A class of neighbouring characters."""
    return 0 if not c else 1 if c.isspace() else 2 if c in "0123456789" else 3 if c.isalpha() else 4 if c in "+(" else 5 if c in ".-/:=@_" else 6


def feature_row(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a candidate, as numbers."""
    a, kind, b = span
    s = text[a:b]
    groups = GROUP.findall(s)
    sizes, digits = [len(g) for g in groups] or [0], "".join(groups)
    before, after = text[max(0, a - 40):a], text[b:b + 8]
    cue = LAST_WORD.search(before)
    dots = s.lower()
    return [*(float(kind == k) for k in range(4)), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], float(len(digits) > 11 and luhn(digits)),
            float(s[:1] == "+"), float(digits[:2] == "00"), s.count("("), s.count(")"), s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("["), len(s),
            kind_of(before[-1:]), kind_of(after[:1]), kind_of(before.rstrip()[-1:]), kind_of(after.lstrip()[:1]), float(small_parts(s)) if kind == IP else -1.0,
            len(set(digits)), float(digits[:1] or -1), s.count("@"), float(" at " in dots or "at]" in dots or "at)" in dots), float("dot" in dots),
            len(s) - len(s.rstrip("abcdefghijklmnopqrstuvwxyz")) if kind == EMAIL else -1.0, float(bool(cue) and cue[1].lower() in CUES[kind])]


WIDTH = len(feature_row("", (0, 0, 0)))


def overlaps(a: int, b: int, spans) -> bool:
    return any(a < e and s < b for s, _, e, *_ in spans)


def labelled(text: str) -> list[tuple[tuple[int, int, int], int]]:
    """The candidates of a text whose label the formats tell."""
    base, failed = base_spans(text)
    exact, out = set(base), []
    for c in candidates(text):
        a, kind, b = c
        if c in exact:
            out.append((c, 1))
        elif overlaps(a, b, base):
            out.append((c, 0))
        elif not overlaps(a, b, [f for f in failed if not f[3]]):
            out.append((c, 0))
    return out


def disguises(kind: int, s: str, other: str) -> list[tuple[str, int, int]]:
    """(text, start, end of the span in it): what the formats miss."""
    if kind == EMAIL:
        name, _, host = s.partition("@")
        forms = [f"{name}{at}{host.replace('.', dot)}" for at, dot in ((" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."))]
        return [(f, 0, len(f)) for f in forms]
    if kind == IP:
        return [(f, 0, len(f)) for f in (s.replace(".", "[.]"), s.replace(".", " . "), s.replace(".", "(.)"))]
    beside = [(f"{s} {other}", 0, len(s)), (f"{other} {s}", len(other) + 1, len(other) + 1 + len(s))]
    digits = digits_of(s)
    if kind == CARD:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return beside + [(f, 0, len(f)) for f in (".".join(fours), "/".join(fours), "  ".join(fours))]
    return beside + [(f, 0, len(f)) for f in ("00" + s[1:], s.replace("-", "/"))]


def examples(text: str) -> list[tuple[str, tuple[int, int, int], int]]:
    """(text, candidate, label): the text's own, and those of its base spans in disguise."""
    out = [(text, c, y) for c, y in labelled(text)]
    base, _ = base_spans(text)
    numbers = [text[a:b] for a, k, b in base if k in (CARD, PHONE, IP)]
    for at, (a, kind, b) in enumerate(base):
        left, right = text[max(0, a - 40):a], text[b:b + 40]
        other = numbers[at % len(numbers)] if numbers else "2"
        for form, begin, end in disguises(kind, text[a:b], other):
            made = left + form + right
            place = (len(left) + begin, kind, len(left) + end)
            for c in candidates(made):
                if c == place or overlaps(c[0], c[2], [place]):
                    out.append((made, c, int(c == place)))
    return out


def quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Inner edges of BINS bins of about equal numbers; the values are in order."""
    upto = np.cumsum(counts)
    places = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1))
    return np.unique(values[np.searchsorted(upto, places, side="right")])


class Examples:
    """Binned examples in one process: `sums` adds up what a level of a tree is chosen from."""

    def __init__(self, binned: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.binned, self.y, self.n = binned, y, n
        self.z, self.seen = None, 0

    def sums(self, bias: float, trees: list, part: tuple, level: int) -> np.ndarray:
        """(2, node of the level, feature, bin): gradients and curvatures in whole units of UNIT; at level DEPTH, of the leaves, under feature and bin 0."""
        rows, width = self.binned.shape
        if self.z is None:
            self.z = np.full(rows, bias)
        for tree in trees[self.seen:]:
            self.z += Trees.leaf_values(tree, self.binned)
        self.seen = len(trees)
        p = 1 / (1 + np.exp(-self.z))
        g, h = np.rint((p - self.y) * UNIT) * self.n, np.rint(p * (1 - p) * UNIT) * self.n
        node = np.zeros(rows, np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (self.binned[np.arange(rows), part[0][node]] > part[1][node])
        count = 2**level
        node -= count - 1
        out = np.zeros((2, count, width, BINS + 1))
        for f in range(width if level < DEPTH else 1):
            key = node * (BINS + 1) + (self.binned[:, f] if level < DEPTH else 0)
            for i, v in enumerate((g, h)):
                out[i, :, f] = np.bincount(key, v, count * (BINS + 1)).reshape(count, -1)
        return out.astype(np.int64)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over quantile bins; leaves take Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [quantiles(*np.unique(x[:, f], return_counts=True)) for f in range(x.shape[1])] if len(x) else []
        self.start(edges, int(y.sum()), len(y))
        if not self.told:
            return
        self.boost(Examples(self.bins(x), y, np.ones(len(y))).sums)

    def start(self, edges: list, hits: int, n: int) -> None:
        self.edges, self.trees, self.told = edges, [], 0 < hits < n
        self.bias = float(np.log(hits / (n - hits))) if self.told else -40.0  # nothing to tell apart

    @classmethod
    def untrained(cls, edges: list, hits: int, n: int) -> Trees:
        """For `boost`: the edges of each feature, and how many of `n` examples are positive."""
        out = cls.__new__(cls)
        out.start(edges, hits, n)
        return out

    def boost(self, sums) -> None:
        for _ in range(TREES if self.told else 0):
            self.trees.append(self.grow(sums))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]).astype(np.int64)

    def grow(self, sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, last bin to the left, leaf value) by node of a full binary tree; a node that is not worth splitting sends all to the left."""
        nodes = 2**DEPTH - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            every = sums(self.bias, self.trees, (feature, cut), level)
            for f in reversed(range(len(self.edges))):  # of features that part the examples alike the last one, which tells more of the whole candidate
                G, H = (every[:, :, f].cumsum(axis=2) / UNIT)
                whole = G[:, -1:] ** 2 / (H[:, -1:] + RIDGE)
                gain = G**2 / (H + RIDGE) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + RIDGE) - whole
                at = gain[:, :-1].argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best
                best[better], feature[first:first + count][better], cut[first:first + count][better] = value[better], f, at[better]
        G, H = sums(self.bias, self.trees, (feature, cut), DEPTH)[:, :, 0, 0] / UNIT
        return feature, cut, -RATE * G / (H + RIDGE)

    @staticmethod
    def leaf_values(tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.score_binned(self.bins(x) if len(x) and self.trees else np.zeros((len(x), 0), np.int64))

    def score_binned(self, binned: np.ndarray) -> np.ndarray:
        z = np.full(len(binned), self.bias)
        for tree in self.trees if len(binned) else ():
            z += self.leaf_values(tree, binned)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def surely_above(hits: int, n: int, share: float, confidence: float) -> bool:
    """Whether `hits` of `n` refute, by the exact binomial tail, that at most `share` of all are hits."""
    if hits <= n * share:
        return False
    lf = math.lgamma
    terms = []
    for i in range(hits, n + 1):  # beyond the mode, so they fall
        terms.append(lf(n + 1) - lf(i + 1) - lf(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share))
        if terms[-1] < terms[0] - 60:
            break
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms)) <= math.log(1 - confidence)


def lowest(counts) -> float:
    """The lowest of STEPS, from (hits, all) at and above each, that is surely precise; infinite if there is none. Looser ones are tried after tighter ones held."""
    best = math.inf
    for t, (hits, n) in zip(STEPS, counts):
        if surely_above(int(hits), int(n), PRECISION, CONFIDENCE):
            best = t
        elif best < math.inf:
            break
    return best


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The lowest score, one half at least, from which on the precision is surely above PRECISION."""
    return lowest([(y[score >= t].sum(), (score >= t).sum()) for t in STEPS])


def training_rows(docs: DataFrame) -> DataFrame:
    """(held, kind, label, features, n) of the candidates of all documents that are judged, equal ones as one row."""
    source = texts(docs).where(F.col("doc_id").isNotNull() & F.col("text").rlike(HOT))
    kinds = {"held": pa.bool_(), "kind": pa.int32(), "label": pa.int32(), "features": pa.list_(pa.float32()), "n": pa.int64()}

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            found: Counter = Counter()
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held = zlib.crc32(str(d).encode()) % 3 == 0
                found.update((held, c[1], y, tuple(feature_row(made, c))) for made, c, y in examples(text))
            columns = list(zip(*((*key, n) for key, n in found.items()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    made = source.mapInArrow(run, "held boolean, kind int, label int, features array<float>, n long")
    return made.groupBy("held", "kind", "label", "features").agg(F.sum("n").alias("n"))


def binned_rows(rows: DataFrame, trees: Trees) -> DataFrame:
    """(held, kind, label, code, n): a byte for the bin of each feature."""
    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            code = [c.tobytes() for c in trees.bins(x).astype(np.uint8)] if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column("held"), batch.column("kind"), batch.column("label"), pa.array(code, pa.binary()), batch.column("n")],
                                             ["held", "kind", "label", "code", "n"])

    return rows.mapInArrow(run, "held boolean, kind int, label int, code binary, n long").groupBy("held", "kind", "label", "code").agg(F.sum("n").alias("n"))


def codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def as_examples(table) -> Examples:
    return Examples(codes(table.column("code")), table.column("label").to_numpy().astype(np.float64), table.column("n").to_numpy().astype(np.float64))


def spread_sums(table: DataFrame):
    """The sums of `Examples`, made by the tasks that scan the table; the driver gets one row for each node, feature and bin."""
    def sums(bias, trees, part, level):
        shape = (2, 2**level, WIDTH, BINS + 1)

        def run(batches):
            total = np.zeros(shape, np.int64)
            for batch in batches:
                total += as_examples(batch).sums(bias, trees, part, level)
            g, h = total.reshape(2, -1)
            slot = np.flatnonzero((g != 0) | (h != 0))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(g[slot]), pa.array(h[slot])], ["slot", "g", "h"])

        got = table.mapInArrow(run, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((2, math.prod(shape[1:])), np.int64)
        out[:, got.column("slot").to_numpy()] = got.column("g").to_numpy(), got.column("h").to_numpy()
        return out.reshape(shape)
    return sums


def limits_of(held: DataFrame, trees: Trees) -> list[float]:
    """The threshold of each kind from the examples that were not fitted on."""
    def run(batches):
        total = np.zeros((len(KINDS), len(STEPS), 2), np.int64)
        for batch in batches:
            score = trees.score_binned(codes(batch.column("code")))
            kind, y, n = (batch.column(c).to_numpy() for c in ("kind", "label", "n"))
            for i, t in enumerate(STEPS):
                for at, v in enumerate((y * n, n)):
                    total[:, i, at] += np.bincount(kind[score >= t], v[score >= t], len(KINDS)).astype(np.int64)
        k, i = np.divmod(np.arange(len(KINDS) * len(STEPS)), len(STEPS))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), *map(pa.array, total.reshape(-1, 2).T.copy())], ["kind", "step", "hits", "n"])

    got = held.mapInArrow(run, "kind int, step int, hits long, n long").groupBy("kind", "step").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    counts = {(r["kind"], r["step"]): (r["hits"], r["n"]) for r in got}
    return [lowest([counts.get((k, i), (0, 0)) for i in range(len(STEPS))]) for k in range(len(KINDS))]


def fit(docs: DataFrame, local_rows: int | None = None) -> tuple[Trees, list[float]]:
    """(trees, threshold of each kind) from all documents; `local_rows` bounds the distinct examples that the driver sums up."""
    rows = written(training_rows(docs), "pii-examples")
    learnt = rows.where(~F.col("held"))
    hits, n = learnt.agg(F.coalesce(F.sum(F.col("label") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    values: list[list] = [[] for _ in range(WIDTH)]
    for f, v, many in learnt.select(F.posexplode("features").alias("f", "v"), "n").groupBy("f", "v").agg(F.sum("n")).collect():  # lengths and counts within a candidate: some hundreds at most
        values[f].append((v, many))
    trees = Trees.untrained([quantiles(*np.array(sorted(vs)).T) for vs in values] if n else [], hits, n)
    if not trees.told:
        return trees, [math.inf] * len(KINDS)
    table = written(binned_rows(rows, trees), "pii-bins")
    learnt = table.where(~F.col("held"))
    small = small_enough(learnt, LOCAL_ROWS if local_rows is None else local_rows)
    trees.boost(as_examples(learnt.toArrow()).sums if small else spread_sums(learnt))
    return trees, limits_of(table.where("held"), trees)


def added(text: str, base, scored: list[tuple[float, tuple[int, int, int]]], limits: list[float]) -> list[tuple[int, int, int]]:
    """The candidates above their thresholds, best first, longer ones of equals first, none over a base span or a better one."""
    taken: list[tuple[int, int, int]] = []
    for _, c in sorted((x for x in scored if x[0] >= limits[x[1][1]]), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
        if not overlaps(c[0], c[2], base) and not overlaps(c[0], c[2], taken):
            taken.append(c)
    return taken


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, done = [], 0
    for a, kind, b in sorted(spans):
        out += [text[done:max(done, a)], f"[{KINDS[kind]}]"] if b > done else []
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (base and added ones) and n_added of every document, and the redacted text on request."""
    trees, limits = fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"] + ["redacted"] * with_text

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            column, n = batch.column("text"), batch.num_rows
            base, more, cleaned = [()] * n, [()] * n, [None] * n
            hot = np.flatnonzero(pc.match_substring_regex(column, HOT).to_numpy(zero_copy_only=False))
            held, rows, owner = {}, [], []
            for i in hot.tolist():
                text = held[i] = column[i].as_py()
                base[i] = base_spans(text)[0]
                exact = set(base[i])
                own = [c for c in candidates(text) if c not in exact and limits[c[1]] < math.inf]
                owner += [(i, c) for c in own]
                rows += [feature_row(text, c) for c in own]
            score = trees.score(np.array(rows, dtype=np.float64).reshape(-1, WIDTH))
            by: dict[int, list] = {}
            for s, (i, c) in zip(score.tolist(), owner):
                by.setdefault(i, []).append((s, c))
            for i, scored in by.items():
                more[i] = added(held[i], base[i], scored, limits)
            if with_text:
                cleaned = [redacted(held[i], [*base[i], *more[i]]) if i in held else column[i].as_py() for i in range(n)]
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b in base]),
                 pa.array([shown([*b, *m]) for b, m in zip(base, more)]), pa.array([len(m) for m in more], pa.int64()), *([pa.array(cleaned, pa.string())] * with_text)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
                                       + ", redacted string" * with_text)
