"""A large JSON array as rows, read by many tasks.

Ranges of bytes are walked once without knowing what came before them: for each of both cases, starting inside a string or outside, a task
tells how the range ends, how the depth changes and how many objects it opens at each relative depth. A running composition of these few numbers
gives every range its true start; a second pass then cuts out the objects that start in it.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RANGE_BYTES = 32 << 20  # of a task; longer where a file would have more than RANGES of them
RANGES = 4_096
BLOCK_BYTES = 4 << 20  # read at a time

TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|["{}\[\]]', re.S)
REST_OF_STRING = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)
QUOTE, OPENING = b'"', (b"{", b"[")

RANGE_SCHEMA = "part int, lo bigint, hi bigint, size bigint"
STATE_SCHEMA = "part int, inside boolean, ends_inside boolean, change int, first string, opened map<int,bigint>"
START_SCHEMA = f"{RANGE_SCHEMA}, inside boolean, depth int, level int, before bigint"


def open_mounted(path: str) -> BinaryIO:
    """A file of a file system that the workers mount."""
    return open("/" + path.removeprefix("file:").lstrip("/"), "rb")


def _reader(stream: BinaryIO) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)
    return read


def _odd_backslashes(block: bytes) -> bool:
    return (len(block) - len(block.rstrip(b"\\"))) % 2 == 1


def _first_of(read, at: int, inside: bool) -> int:
    """Where to begin: one byte later if the one at `at` is escaped."""
    n = 16
    while inside and at and n < 2 * at and not read(max(0, at - n), min(n, at)).strip(b"\\"):
        n *= 2
    return at + (inside and at > 0 and _odd_backslashes(read(max(0, at - n), min(n, at))))


def _brackets(read, at: int, stop: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, byte) of the brackets outside strings; at last (stop, quote) if it ends inside a string, else (stop, nothing)."""
    at = _first_of(read, at, inside)
    while at < stop:
        block = read(at, min(BLOCK_BYTES, stop - at))
        if not block:
            break
        start = 0
        if inside:
            rest = REST_OF_STRING.match(block)
            inside, start = rest is None, rest.end() if rest else len(block)
        for m in TOKEN.finditer(block, start):
            if m.group() == QUOTE:  # no end in this block
                inside = True
                break
            if m.end() - m.start() == 1:
                yield at + m.start(), m.group()
        again = inside and len(block) > 1 and _odd_backslashes(block)  # a pair of escape and escaped byte is not torn
        at += len(block) - again
    yield stop, QUOTE if inside else b""


def _states(get, path: str):
    """Each range from both possible starts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                out = []
                with get(path) as stream:
                    for inside in (False, True):
                        depth, first, opened, end = 0, None, Counter(), b""
                        for _, end in _brackets(_reader(stream), r.lo, r.hi, inside):
                            if end in OPENING:
                                first = first or end.decode()
                                opened[depth] += end == b"{"
                                depth += 1
                            elif end in (b"}", b"]"):
                                depth -= 1
                        out.append((r.part, inside, end == QUOTE, depth, first, dict(opened)))
                yield pd.DataFrame(out, columns=["part", "inside", "ends_inside", "change", "first", "opened"])
    return run


def _objects(get, path: str):
    """The objects that start in each range, numbered over the file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with get(path) as stream:
                    read, depth, start, n = _reader(stream), r.depth, None, r.before
                    for at, mark in _brackets(read, r.lo, r.size, r.inside):
                        if at >= r.hi and start is None:
                            break
                        if mark in OPENING:
                            if mark == b"{" and depth == r.level:
                                start = at
                            depth += 1
                        elif mark:
                            depth -= mark != QUOTE
                            if start is not None and depth == r.level:
                                yield pd.DataFrame({"at": [n], "value": [read(start, at + 1 - start).decode("utf-8", "replace")]})
                                start, n = None, n + 1
    return run


def json_objects(spark: SparkSession, path: str, open_file: Callable[[str], BinaryIO] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """(at, value): the objects of the JSON array in file `path` as texts with their position, or the one object of a file that holds no array.

    Other elements than objects are left out and not counted. None for an empty file, and where tasks cannot open the file: it lies in no mounted file
    system and there is no `open_file`. What comes to the driver is a row a range, RANGES at most.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    get = open_file or open_mounted
    if len(found) != 1 or (open_file is None and not found[0]["path"].startswith("file:")):
        return None
    name, size = found[0]
    step = max(range_bytes, -(-size // RANGES), 1)
    ranges = [(i, lo, min(lo + step, size), size) for i, lo in enumerate(range(0, size, step))]
    tasks = max(1, len(ranges))
    told = spark.createDataFrame(ranges, RANGE_SCHEMA).repartitionByRange(tasks, "part").mapInPandas(_states(get, name), STATE_SCHEMA)
    states = {(r["part"], r["inside"]): r for r in told.collect()}
    starts, inside, depth, level, before = [], False, 0, None, 0
    for part, *rest in ranges:
        state = states[part, inside]
        if level is None and state["first"]:
            level = int(state["first"] == "[")
        starts.append((part, *rest, inside, depth, level or 0, before))
        before += state["opened"].get((level or 0) - depth, 0)
        inside, depth = state["ends_inside"], depth + state["change"]
    return spark.createDataFrame(starts, START_SCHEMA).repartitionByRange(tasks, "part").mapInPandas(_objects(get, name), "at bigint, value string")
