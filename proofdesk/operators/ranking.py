"""BM25, cosine similarity, top-k and reciprocal rank fusion.

Scoring visits each unit once, in the task that scans it: the (measured, bounded) query block travels to the
tasks, every task keeps its k best per query, and only those k rows per query and task are shuffled. Neither
postings nor (query, unit) scores are exchanged. More queries than a block holds are scored block by block.
BM25 keeps sparse triples and skips chunks of units whose largest contributions cannot reach a query's k-th best score.

units(unit_ord bigint, text [, hidden array<string>]): unit_ord breaks ties; `hidden` lists the corpus ids
that must not see the unit. queries(query_id, text [, corpus_id]).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.batches import text_pieces
from ..functions.batches import tokens as _tokens
from ..session import bounded_blocks, broadcast_if_bounded, cut_lineage, written

# BM25, fusion and candidate constants, and the floor of a vector norm.
K1, B = 1.5, 0.75
RRF_K = 60
CANDIDATES = 40
NORM_FLOOR = 1e-9

BLOCK_QUERIES = 2_000
BLOCK_BYTES = 32 << 20
CHUNK_CELLS = 4_000_000
CHUNK_UNITS = 512  # units whose largest contributions are bounded together
BOUND_SLACK = 1e-9  # bounds are rounded differently from scores, by far less
PAIR_SLACK = 1e-3  # the same of bounds in single precision


def _optional(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def _query_blocks(queries: DataFrame, payload: str) -> Iterator[tuple[list, int]]:
    return bounded_blocks(queries, "query_id", payload, BLOCK_QUERIES, BLOCK_BYTES)


def _keep_best(scored: Iterator[tuple[np.ndarray, np.ndarray]], n_queries: int, k: int):
    """Running k best per query over (unit_ord, score matrix) chunks; -inf marks a hidden unit."""
    score = np.full((n_queries, k), -np.inf)
    unit = np.full((n_queries, k), np.iinfo(np.int64).max)
    for ords, s in scored:
        worst, last = score[:, -1:], unit[:, -1:]
        better = (s > worst) | ((s == worst) & (ords < last) & (s > -np.inf))
        for q in np.flatnonzero(better.any(axis=1)):
            hit = np.flatnonzero(better[q])
            all_s, all_u = np.concatenate([score[q], s[q, hit]]), np.concatenate([unit[q], ords[hit]])
            top = np.lexsort((all_u, -all_s))[:k]
            score[q], unit[q] = all_s[top], all_u[top]
    return score, unit


def _emit(score, unit, ids: pa.Array) -> pa.RecordBatch:
    q, slot = np.nonzero(score > -np.inf)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(unit[q, slot]), pa.array(score[q, slot])],
                                      names=["query_id", "unit_ord", "score"])


def _mask_hidden(s: np.ndarray, hidden: pa.Array | None, members: dict[str, np.ndarray]) -> None:
    """Set the score of (query, unit) to -inf where the unit is hidden from the query's corpus."""
    if hidden is None or not members:
        return
    for row, names in enumerate(hidden.to_pylist()):
        for name in names or ():
            if name in members:
                s[members[name], row] = -np.inf


def _members(rows) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r["corpus_id"] is not None:
            out.setdefault(r["corpus_id"], []).append(i)
    return {c: np.array(i) for c, i in out.items()}


def rank(scored: DataFrame, k: int, tie: str = "unit_ord", out: str = "rank") -> DataFrame:
    """Zero-based rank by (score descending, tie) per query, cut to k. Catalyst limits each task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn(out, F.row_number().over(w) - 1).where(F.col(out) < k)


def _ranked_blocks(parts: list[DataFrame], k: int, blocks: int) -> DataFrame:
    ranked = [rank(p, k) for p in parts]
    if blocks > 1:
        ranked = [cut_lineage(p) for p in ranked]
    return reduce(DataFrame.unionByName, ranked)


def _result_schema(queries: DataFrame) -> ty.StructType:
    return ty.StructType([ty.StructField("query_id", queries.schema["query_id"].dataType),
                          ty.StructField("unit_ord", ty.LongType()), ty.StructField("score", ty.DoubleType())])


# ---------- BM25 ----------

def idf(n, f):
    return F.ln(1 + (n - f + 0.5) / (f + 0.5))


def term_stats(units: DataFrame) -> DataFrame:
    """(term, df, idf) over the whole vocabulary: map-side distinct, then one pre-aggregated exchange on term."""
    n = units.count()
    listed = units.select(F.array_distinct(T.words(F.col("text"))).alias("t"))
    df = listed.select(F.explode_outer("t").alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", idf(F.lit(float(n)), F.col("df")).alias("idf"))


def _term_counts(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(corpus, term, n, len) of the terms that queries ask for: units and tokens of the units holding the term, in one scan for all blocks.

    corpus '' counts every unit; a hidden corpus counts the units kept from it, for the terms of its own queries alone. The empty
    string, which the tokenizer never yields, stands for the unit itself.
    """
    asked = queries.select(F.coalesce("corpus_id", F.lit("")).alias("corpus"), F.explode(F.array_union(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
    wanted = asked.union(asked.select(F.lit(""), "term")).distinct()
    rows = (tokens.select(F.size("t").alias("len"), F.concat(F.array(F.lit("")), F.coalesce("hidden", F.array().cast("array<string>"))).alias("c"),
                          F.explode_outer(F.array_union(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
            .select("term", "len", F.explode_outer("c").alias("corpus")))
    return (rows.join(broadcast_if_bounded(wanted), ["corpus", "term"])
            .groupBy("corpus", "term").agg(F.count("*").alias("n"), F.sum("len").alias("len")))


def _block_stats(counts: DataFrame, rows: list, blocks: int) -> dict:
    """{(corpus, term): (n, len)} of one block's queries, no more entries than the block has tokens."""
    if blocks > 1:
        wanted = {(c, t) for r in rows for t in ("", *r["t"]) for c in ("", r["corpus_id"] or "")}
        keys = counts.sparkSession.createDataFrame(sorted(wanted), "corpus string, term string")
        counts = counts.join(F.broadcast(keys), ["corpus", "term"])
    return {(r["corpus"], r["term"]): (r["n"], r["len"]) for r in counts.collect()}


def bm25_topk(units: DataFrame, queries: DataFrame, k: int = CANDIDATES, *, k1: float = K1, b: float = B,
              round_to: int | None = None) -> DataFrame:
    """(query_id, unit_ord, score, rank): the k best units per query; units matching nothing score 0 and count.

    Repeated query tokens count again and contributions are added in query order. `round_to` ranks by rounded
    scores. A query with a corpus_id is scored on the statistics of what its corpus may see.
    """
    parts, blocks = _bm25_parts(units, queries, k, k1, b, round_to)
    if not parts:
        return units.sparkSession.createDataFrame([], _result_schema(queries)).withColumn("rank", F.lit(0))
    return _ranked_blocks(parts, k, blocks)


def bm25_scores(units: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B, round_to: int | None = None) -> DataFrame:
    """(query_id, unit_ord, score) of every unit that shares a token with the query and is not hidden from it; all others score 0.

    Scores are those of `bm25_topk`. Rows leave the tasks as they are made and nothing is shuffled, so only the sink limits them.
    """
    parts, _ = _bm25_parts(units, queries, None, k1, b, round_to)
    return reduce(DataFrame.unionByName, parts) if parts else units.sparkSession.createDataFrame([], _result_schema(queries))


def _bm25_parts(units, queries, k, k1, b, round_to) -> tuple[list[DataFrame], int]:
    """One scan of the units per block of queries, and how many blocks there are."""
    tokens = units.select("unit_ord", T.words(F.col("text")).alias("t"), _optional(units, "hidden", "array<string>"))
    source = tokens if "hidden" in units.columns else tokens.drop("hidden")
    qs = queries.select("query_id", "text", T.words(F.col("text")).alias("t"), _optional(queries, "corpus_id", "string"))
    schema = _result_schema(queries)
    id_type = to_arrow_type(schema["query_id"].dataType)
    parts, blocks, counts = [], 1, None
    for rows, blocks in _query_blocks(qs, "text"):
        vocab = sorted({t for r in rows for t in r["t"] or ()})
        if blocks == 1 and "hidden" not in units.columns:
            lower = units.select("unit_ord", F.lower("text").alias("text"))
            source = written(lower.mapInArrow(_encoder(vocab), "unit_ord long, len long, codes array<int>"), "bm25-codes")
            kernel = _bm25_kernel(rows, vocab, _coded_stats(source, vocab), k, k1, b, round_to, id_type)
            return [source.mapInArrow(kernel, schema)], blocks
        if counts is None:
            counts = _term_counts(tokens, qs)
            counts = cut_lineage(counts) if blocks > 1 else counts
        kernel = _bm25_kernel(rows, vocab, _block_stats(counts, rows, blocks), k, k1, b, round_to, id_type)
        parts.append(source.mapInArrow(kernel, schema))
    return parts, blocks


def _codes(piece: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, unit, code): tokens of each unit, and the vocabulary numbers of those that are in it."""
    if "codes" in piece.schema.names:
        codes = piece.column("codes")
        sizes = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
        return piece.column("len").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if "text" in piece.schema.names:
        length, toks = _tokens(piece.column("text"))
    else:
        listed = piece.column("t")
        length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        toks = listed.flatten().cast(pa.string())
    code = pc.fill_null(pc.index_in(toks, value_set=known), -1).to_numpy(zero_copy_only=False)
    on = code >= 0
    return length, np.repeat(np.arange(len(length)), length)[on], code[on].astype(np.int64)


def _encoder(vocab: list[str]) -> Callable:
    """Units as their length and the vocabulary numbers of their tokens, so that both the statistics and the scores read a small table instead of the text."""
    def run(batches):
        known = pa.array(vocab, type=pa.string())
        for piece in (p for batch in batches for p in text_pieces(batch)):
            length, unit, code = _codes(piece, known)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(length)))])
            yield pa.RecordBatch.from_arrays([piece.column("unit_ord"), pa.array(length), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code, pa.int32()))],
                                             ["unit_ord", "len", "codes"])
    return run


def _coded_stats(coded: DataFrame, vocab: list[str]) -> dict:
    """{('', term): (units with it, 0)} and, under the empty term, the number of units and their tokens."""
    def run(batches):
        n, total, df = 0, 0, np.zeros(len(vocab), dtype=np.int64)
        for batch in batches:
            length, unit, code = _codes(batch, None)
            n, total = n + len(length), total + int(length.sum())
            df += np.bincount(np.unique(unit * len(vocab) + code) % max(1, len(vocab)), minlength=len(vocab))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held], pa.int32()), pa.array([n, *df[held]], pa.int64()), pa.array([total, *([0] * len(held))], pa.int64())],
                                         ["code", "n", "len"])

    got = coded.mapInArrow(run, "code int, n long, len long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("len").alias("len")).collect()
    return {("", vocab[r["code"]] if r["code"] >= 0 else ""): (r["n"], r["len"]) for r in got}


def _triples(piece: pa.RecordBatch, known: pa.Array):
    """(length, starts, unit, tf): the units' token counts, and per vocabulary term the slice of units that hold it with their counts."""
    length, unit, code = _codes(piece, known)
    cell, tf = np.unique(code * len(length) + unit, return_counts=True)
    starts = np.searchsorted(cell, np.arange(len(known) + 1) * len(length))
    return length, starts, cell % max(1, len(length)), tf.astype(float)


def _bm25_kernel(rows, vocab, stats, k, k1, b, round_to, id_type) -> Callable:
    """k best units per query of the units of a task, or all that match where k is None, from (term, unit, tf) triples.

    The units pass in chunks. A term's largest contribution in a chunk bounds what the chunk can add to a query; a query whose bounds
    do not reach its k-th best score leaves the chunk unscored. Memory goes with the triples of a chunk and k rows per query.
    """
    place = {t: i for i, t in enumerate(vocab)}
    members = _members(rows)
    plans = []
    for r in rows:
        corpus = r["corpus_id"]

        def seen(term, corpus=corpus):
            n, length = stats.get(("", term), (0, 0))
            if corpus:
                n_out, len_out = stats.get((corpus, term), (0, 0))
                n, length = n - n_out, length - len_out
            return n, length

        n, total = seen("")
        terms = [(place[t], float(np.log(1 + (n - f + 0.5) / (f + 0.5)))) for t in r["t"] or () if (f := seen(t)[0])]
        plans.append((corpus if corpus and (corpus, "") in stats else None, total / max(1, n), terms))
    ids = pa.array([r["query_id"] for r in rows], type=id_type)
    step = CHUNK_UNITS
    # flat (query, term, weight) in query order: one bincount adds a query's bounds in the order of its terms
    flat_query = np.array([q for q, (_, _, terms) in enumerate(plans) for _ in terms], dtype=np.int64)
    flat_term = np.array([t for _, _, terms in plans for t, _ in terms], dtype=np.int64)
    flat_weight = np.array([w for _, _, terms in plans for _, w in terms], dtype=float)
    longest = max((avg for _, avg, _ in plans), default=0.0)
    n_terms = np.array([len(terms) for _, _, terms in plans], dtype=np.int64)
    first_term, average = np.cumsum(n_terms) - n_terms, np.array([avg for _, avg, _ in plans], dtype=float)

    def norms(length, avg):
        return k1 * (1 - b + b * length / avg) if avg else np.full(len(length), k1)

    def bounds(length, starts, unit, tf) -> np.ndarray:
        """What no unit of the chunk exceeds, per query: the shortest norms, those of the longest average, serve all corpora."""
        top = np.zeros(len(vocab))
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            top[filled] = np.maximum.reduceat(tf * (k1 + 1) / (tf + norms(length, longest)[unit]), starts[filled])
        most = np.bincount(flat_query, weights=flat_weight * top[flat_term], minlength=len(plans)) * (1 + BOUND_SLACK)
        return most if round_to is None else np.round(most, round_to)

    class Chunk:
        """Scores of a chunk's units, a query at a time; contributions are shared by the queries of a corpus."""

        def __init__(self, piece: pa.RecordBatch, known: pa.Array):
            self.ords = piece.column("unit_ord").to_numpy()
            self.length, self.starts, self.unit, self.tf = _triples(piece, known)
            self.hidden = _hidden_rows(piece, members)
            self.norm, self.memo = {}, {}

        def scores(self, q: int) -> tuple[np.ndarray, np.ndarray]:
            """(score per unit, units that hold a term of the query): hidden units score -inf and are not among them."""
            corpus, avg, terms = plans[q]
            if corpus not in self.norm:
                self.norm[corpus] = norms(self.length, avg)
            s, met = np.zeros(len(self.length)), np.zeros(len(self.length), dtype=bool)
            for term, weight in terms:
                held = slice(self.starts[term], self.starts[term + 1])
                at_units, f = self.unit[held], self.tf[held]
                part = self.memo.get((corpus, term))
                if part is None:
                    part = self.memo[corpus, term] = weight * f * (k1 + 1) / (f + self.norm[corpus][at_units])
                s[at_units] += part
                met[at_units] = True
            if round_to is not None:
                s = np.round(s, round_to)
            out = self.hidden.get(rows[q]["corpus_id"])
            if out is not None:
                s[out], met[out] = -np.inf, False
            return s, met

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        known = pa.array(vocab, type=pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield Chunk(batch.slice(at, step), known)

    def every(batches):
        for c in chunks(batches):
            for q in range(len(plans)):
                s, met = c.scores(q)
                hit = np.flatnonzero(met)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(hit), q))), pa.array(c.ords[hit]), pa.array(s[hit])],
                                                     names=["query_id", "unit_ord", "score"])

    def pair_scores(length: np.ndarray, slot: np.ndarray, tf: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Scores of (query, unit) pairs, each query's contributions added in its order as in `Chunk.scores`."""
        norm = np.full(len(q), k1)
        some = average[q] > 0
        norm[some] = k1 * (1 - b + b * length[u[some]] / average[q[some]])
        s = np.zeros(len(q))
        for at in range(int(n_terms[q].max(initial=0))):
            flat = np.minimum(first_term[q] + at, len(flat_term) - 1)
            f = tf[slot[flat_term[flat]], u]
            hit = np.flatnonzero((at < n_terms[q]) & (f > 0))
            s[hit] += flat_weight[flat[hit]] * f[hit] * (k1 + 1) / (f[hit] + norm[hit])
        return s if round_to is None else np.round(s, round_to)

    def pairs(c: Chunk, live: np.ndarray, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, unit, score) of the pairs that may be among the k best: a product of bounded size bounds every pair as `bounds` does a chunk."""
        alive, wanted = np.zeros(len(plans), dtype=bool), np.zeros(len(vocab), dtype=bool)
        alive[live] = True
        wanted[flat_term[alive[flat_query]]] = True
        held = np.diff(c.starts)
        present = np.flatnonzero(wanted & (held > 0))
        slot = np.zeros(len(vocab) + 1, dtype=np.int64)  # row 0 stands for the terms that the chunk lacks or no live query asks for
        slot[present] = np.arange(1, len(present) + 1)
        row, floor = np.repeat(slot[:-1], held), np.maximum(norms(c.length, longest), 1e-300)
        row, unit, count = row[row > 0], c.unit[row > 0], c.tf[row > 0]
        part = (count * (k1 + 1) / (count + floor[unit])).astype(np.float32)
        width = max(1, CHUNK_CELLS // (len(present) + 1))
        for at in range(0, len(c.length), width):
            stop = min(len(c.length), at + width)
            own = (unit >= at) & (unit < stop)
            tf, most = np.zeros((len(present) + 1, stop - at)), np.zeros((len(present) + 1, stop - at), dtype=np.float32)
            tf[row[own], unit[own] - at] = count[own]
            most[row[own], unit[own] - at] = part[own]
            for some in (live[i:i + width] for i in range(0, len(live), width)):
                place_of = np.full(len(plans), -1)
                place_of[some] = np.arange(len(some))
                asked = (place_of[flat_query] >= 0) & (slot[flat_term] > 0)
                weight = np.zeros((len(some), len(present) + 1), dtype=np.float32)
                np.add.at(weight, (place_of[flat_query[asked]], slot[flat_term[asked]]), flat_weight[asked])
                may = weight @ most * np.float32(1 + PAIR_SLACK) + np.float32(PAIR_SLACK) >= best[some, -1:]
                for corpus, out in c.hidden.items():
                    may[np.ix_(np.isin(some, members[corpus]), [u - at for u in out if at <= u < stop])] = False
                q, u = np.nonzero(may)
                yield some[q], u + at, pair_scores(c.length[at:stop], slot, tf, some[q], u)

    def run(batches):
        best = np.full((len(plans), k), -np.inf)
        which = np.full((len(plans), k), np.iinfo(np.int64).max)
        for c in chunks(batches):
            most = bounds(c.length, c.starts, c.unit, c.tf)
            live = np.flatnonzero((most > best[:, -1]) | ((most == best[:, -1]) & (c.ords.min() < which[:, -1])))
            for q, u, s in pairs(c, live, best) if len(live) else ():
                enters = (s > best[q, -1]) | ((s == best[q, -1]) & (c.ords[u] < which[q, -1]))
                q, u, s = q[enters], u[enters], s[enters]
                cut = np.searchsorted(q, np.arange(len(plans) + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    mine = slice(cut[i], cut[i + 1])
                    all_s, all_u = np.concatenate([best[i], s[mine]]), np.concatenate([which[i], c.ords[u[mine]]])
                    keep = np.lexsort((all_u, -all_s))[:k]
                    best[i], which[i] = all_s[keep], all_u[keep]
        yield _emit(best, which, ids)
    return every if k is None else run


def _hidden_rows(piece: pa.RecordBatch, members: dict) -> dict[str, list[int]]:
    """Per corpus of the block, the rows of the chunk that it must not see."""
    out: dict[str, list[int]] = {}
    if members and "hidden" in piece.schema.names:
        for row, names in enumerate(piece.column("hidden").to_pylist()):
            for name in set(names or ()):
                if name in members:
                    out.setdefault(name, []).append(row)
    return out


# ---------- dense ----------

def dense_topk(units: DataFrame, queries: DataFrame, k: int = CANDIDATES, *, round_to: int | None = None) -> DataFrame:
    """Cosine top-k. units(unit_ord, embedding [, hidden]) and queries(query_id, embedding [, corpus_id])."""
    us = units.select("unit_ord", "embedding", *(["hidden"] if "hidden" in units.columns else []))
    qs = queries.select("query_id", "embedding", _optional(queries, "corpus_id", "string"))
    schema = _result_schema(queries)
    id_type = to_arrow_type(schema["query_id"].dataType)
    parts, blocks = [], 1
    for rows, blocks in _query_blocks(qs, "embedding"):
        parts.append(us.mapInArrow(_dense_kernel(rows, k, round_to, id_type), schema))
    if not parts:
        return units.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return _ranked_blocks(parts, k, blocks)


def dense_scores(units: DataFrame, queries: DataFrame, minimum: float | None = None, *, round_to: int | None = None) -> DataFrame:
    """(query_id, unit_ord, score): cosine of every unit that a query may see, or of those at `minimum` and above.

    Without a minimum that is a row per query and unit; rows leave the tasks as they are made and nothing is shuffled.
    """
    us = units.select("unit_ord", "embedding", *(["hidden"] if "hidden" in units.columns else []))
    qs = queries.select("query_id", "embedding", _optional(queries, "corpus_id", "string"))
    schema = _result_schema(queries)
    id_type = to_arrow_type(schema["query_id"].dataType)
    floor = -np.inf if minimum is None else minimum
    parts = [us.mapInArrow(_dense_kernel(rows, None, round_to, id_type, floor), schema) for rows, _ in _query_blocks(qs, "embedding")]
    return reduce(DataFrame.unionByName, parts) if parts else units.sparkSession.createDataFrame([], schema)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR, None)


def _dense_kernel(rows, k, round_to, id_type, floor=-np.inf) -> Callable:
    q = _unit_rows(np.array([r["embedding"] for r in rows], dtype=float))
    ids = pa.array([r["query_id"] for r in rows], type=id_type)
    members = _members(rows)
    chunk = max(64, CHUNK_CELLS // max(1, len(rows)))

    def chunks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                vec = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
                s = q @ _unit_rows(vec.reshape(piece.num_rows, q.shape[1])).T
                if round_to is not None:
                    s = np.round(s, round_to)
                if "hidden" in piece.schema.names:
                    _mask_hidden(s, piece.column("hidden"), members)
                yield piece.column("unit_ord").to_numpy(), s

    def every(batches):
        for ords, s in chunks(batches):
            at, unit = np.nonzero((s > -np.inf) & (s >= floor))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(ords[unit]), pa.array(s[at, unit])],
                                             names=["query_id", "unit_ord", "score"])

    def run(batches):
        yield _emit(*_keep_best(chunks(batches), len(rows), k), ids)
    return every if k is None else run


# ---------- fusion ----------

def rrf(rankings: list[DataFrame], k: int = RRF_K, limit: int = CANDIDATES, round_to: int | None = None) -> DataFrame:
    """Fuse (query_id, unit_ord, rank) lists: sum of 1/(k + rank + 1), ties by unit_ord. At most one row per list."""
    parts = [r.select("query_id", "unit_ord", F.lit(i).alias("i"), (1.0 / (k + F.col("rank") + 1)).alias("c"))
             for i, r in enumerate(rankings)]
    every = reduce(DataFrame.unionByName, parts)
    got = every.groupBy("query_id", "unit_ord").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
    total = F.aggregate("cs", F.lit(0.0), lambda acc, x: acc + x["c"])
    score = total if round_to is None else F.round(total, round_to)
    return rank(got.select("query_id", "unit_ord", score.alias("score")), limit)
