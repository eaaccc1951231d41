"""Packing documents into windows of fixed length with a controlled mixture of sources.

Every source is a queue of its documents' ids. Deficit round-robin serves the queues: in each window a queue earns its share of the window,
takes what it has earned in whole ids and carries the rest on. The carried deficits need no scan over windows: giving id x of a queue with
weight w the virtual time (x + 1) / w and serving ids in that order (ties by queue, then position) is the same service with unbounded
memory of deficits, so what each queue has been served by the end of any window has a closed form in exact integers. Each task cuts its own
documents by it; deficits thereby carry across windows and partitions, and no ids are shuffled. A queue that runs dry leaves its share to
the others in proportion. Only the last window of all is not full.

There is no bound on sources: each is a queue of its own, and the schedule holds a few integers of each. With more of them a task keeps fewer
windows of it, so time grows with the sources, but the result does not depend on that.

Without given targets the weights are the queues' own totals, so that every window has the corpus's mixture.

Defined results: a null text is empty (its end id alone); a null source shares the queue of the empty name; rows that repeat are packed as
often as they come; null doc_ids stay null; an empty table gives no rows; further columns are not read. A document may be cut anywhere.
"""
from __future__ import annotations

import zlib
from heapq import heapify, heappop, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import texts, written
from .tokens import END_ID, encoded

WINDOW = 4096
KEPT = 1_000_000
SHIFT = 64


class Schedule:
    """Which ids of which queue lie in which window; `totals` and `weights` by queue number, exact integers."""

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        self.totals, self.weights, self.window = totals, weights, window
        self.all = sum(totals)
        self.rate = max(1, sum(w for w, t in zip(weights, totals) if t))
        self.known: dict[int, tuple[list[int], list[int]]] = {}
        self.near: dict[int, int] = {}  # the window of the last piece of each queue

    def served(self, time: int) -> list[int]:
        """Ids of each queue with a virtual time of at most `time` (in units of 2 ** -SHIFT)."""
        return [min(t, ((time + 1) * w - 1) >> SHIFT) for t, w in zip(self.totals, self.weights)] if time >= 0 else [0] * len(self.totals)

    def rank(self, queue: int, x: int) -> int:
        """How many ids are served before id x of this queue."""
        time = ((x + 1) << SHIFT) // self.weights[queue]
        before, until = self.served(time - 1), self.served(time)
        return sum(before) + sum(u - b for b, u in zip(before[:queue], until[:queue])) + x - before[queue]

    def taken(self, window: int) -> tuple[list[int], list[int]]:
        """Ids of each queue in the windows before this one, and the same of all earlier queues together."""
        if window not in self.known:
            if len(self.known) > max(4, KEPT // len(self.totals)):
                self.known.clear()
            want, n = min(self.all, window * self.window), len(self.totals)
            low, high = -1, max((((t << SHIFT) // w) for t, w in zip(self.totals, self.weights) if t), default=0) + 1
            guess = ((want << SHIFT) // self.rate) - ((n << SHIFT) // self.rate)  # right while no queue has run dry
            out = self.served(low)
            while True:
                if low < guess < high:
                    tried = self.served(guess)
                    low, high, out = (guess, high, tried) if sum(tried) <= want else (low, guess, out)
                rest = want - sum(out)
                if rest <= 4 * n or high - low <= 1:
                    break
                guess = (low + high) // 2
            # the next few ids by (time, queue)
            heap = [(((out[q] + 1) << SHIFT) // self.weights[q], q) for q in range(n) if out[q] < self.totals[q]]
            heapify(heap)
            for _ in range(rest):
                q = heap[0][1]
                out[q] += 1
                if out[q] < self.totals[q]:
                    heapreplace(heap, (((out[q] + 1) << SHIFT) // self.weights[q], q))
                else:
                    heappop(heap)
            self.known[window] = out, [0, *accumulate(out)]
        return self.known[window]

    def cut(self, queue: int, begin: int, end: int):
        """(position in the queue, length, window, offset in it) of each piece of the queue's ids [begin, end)."""
        window = self.near.get(queue, 0)
        if begin < end and not self.taken(window)[0][queue] <= begin < self.taken(window + 1)[0][queue]:
            window = self.rank(queue, begin) // self.window
        while begin < end:
            (first, before), (last, until) = self.taken(window), self.taken(window + 1)
            stop = min(end, last[queue])
            if stop > begin:
                yield begin, stop - begin, window, until[queue] - before[queue] + begin - first[queue]
                begin, self.near[queue] = stop, window
                window += 1
            else:  # a queue of few ids: not in each window
                window = self.rank(queue, begin) // self.window


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: dict[str, float] | None = None, end_id: int = END_ID,
         max_queues: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and the ids on request.

    `targets` are shares by source; a source without one is served as if it had a thousandth of the smallest. `max_queues` has no effect any more:
    every source is a queue of its own.
    """

    def lay(batches):
        before: dict[str, int] = {}
        for batch, ids, bounds in encoded(batches, tokenizer, end_id):
            raw, starts = ids.astype("<u4", copy=False), []
            for queue, n in zip(batch.column("source").to_pylist(), np.diff(bounds).tolist()):
                starts.append(before.get(queue, 0))
                before[queue] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                 pa.array([raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                ["doc_id", "queue", "part", "before", "n", "ids"])

    rows = texts(docs.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(""))), "source").withColumn("part", F.spark_partition_id())
    laid = written(rows.mapInArrow(lay, "doc_id long, queue string, part int, before long, n long, ids binary"), "queues")
    # a row for each queue in each part: its place in the whole queue
    sums = laid.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    places = written(sums.select("queue", "part", "n", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base")), "places")
    totals = {r["queue"]: int(r["n"]) for r in places.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row a source
    names = sorted(totals)
    if targets:
        least = min(v for v in targets.values() if v > 0)
        weights = [max(1, round(targets.get(q) / least * 1_000_000)) if targets.get(q, 0) > 0 else 1000 for q in names]
    else:
        weights = [max(1, totals[q]) for q in names]
    plan, number = Schedule([totals[q] for q in names], weights, window), {q: i for i, q in enumerate(names)}

    def cut(batches):
        for batch in batches:
            out = []
            for doc, queue, begin, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "begin", "n")), batch.column("ids")):
                ids = memoryview(raw.as_buffer())
                for at, length, sequence, offset in plan.cut(number[queue], begin, begin + n):
                    piece = ids[4 * (at - begin):4 * (at - begin + length)]
                    out.append((doc, at - begin, length, zlib.crc32(piece), n, sequence, offset, queue, *([bytes(piece)] * with_ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    fields = [pa.field(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [pa.field("queue", pa.string())] + [pa.field("ids", pa.binary())] * with_ids
    joined = laid.join(places.drop("n"), ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("begin"), "n", "ids")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
                             + ", ids binary" * with_ids)
