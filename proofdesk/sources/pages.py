"""Page sources: the paged REST API, landed JSON snapshots, displayed pages and file fingerprints."""
from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import spread
from .arrays import json_objects, open_mounted
from .tables import append_batch, read_batches

# REST path, page size, timeout and politeness pause.
PAGES_PATH = "/wp-json/wp/v2/pages?per_page={per_page}&page={page}"
PER_PAGE, TIMEOUT, PAUSE = 100, 60, 1.0
AGENT = "Mozilla/5.0 (compatible; proofdesk)"

DIGEST_BYTES = 8 << 20  # read at a time from a file
DIGEST_TASKS = 4_096

HOST = r"^[^:/?#]+://([^/?#]*)"
SHOWN_SCHEMA = "url string, html string, problem string"
PAGE_SCHEMA = "page_ord bigint, id bigint, link string, modified string, content struct<rendered:string>"


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT) as r:
        return r.read()


class _Lane(InputPartition):
    def __init__(self, first: int):
        self.first = first


class RestPages(DataSource):
    """spark.read.format('rest_pages').option('site', ..): pages of a site, fetched inside tasks.

    Options: site, per_page, pause, lanes. With several lanes each task takes every lanes-th API page until its
    first empty or short one; the default single lane asks one page at a time. Subclass and override `get` to test.
    """
    get = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(dict(self.options), type(self).get)


class _RestReader(DataSourceReader):
    def __init__(self, options: dict, get: Callable[[str], bytes]):
        self.site = options["site"].rstrip("/")
        self.per_page = int(options.get("per_page", PER_PAGE))
        self.pause = float(options.get("pause", PAUSE))
        self.lanes = int(options.get("lanes", 1))
        self.get = get

    def partitions(self):
        return [_Lane(i + 1) for i in range(self.lanes)]

    def read(self, partition: _Lane) -> Iterator[tuple]:
        from pyspark.sql import Row
        page = partition.first
        while True:
            try:
                batch = json.loads(self.get(self.site + PAGES_PATH.format(per_page=self.per_page, page=page)))
            except urllib.error.HTTPError as e:
                if e.code == 400 and page > 1:  # the API answers 400 beyond its last page
                    return
                raise
            for i, p in enumerate(batch or ()):
                yield ((page - 1) * self.per_page + i, p["id"], p["link"], p["modified"],
                       Row(rendered=p.get("content", {}).get("rendered", "")))
            if len(batch or ()) < self.per_page:
                return
            page += self.lanes
            time.sleep(self.pause)


def fetch_pages(spark: SparkSession, site: str, out: str, source: type[DataSource] = RestPages, **options) -> str:
    """Land a site's pages once under `out`; a finished landing is reused."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and (fs.getFileStatus(path).isFile()
                            or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))):
        return out
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("site", site)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    reader.load().write.mode("overwrite").json(out)
    return out


def load_pages(spark: SparkSession, path: str, open_file: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """A landed folder (JSON lines with page_ord) or one file holding a JSON array, whose order becomes page_ord.

    Tasks read a file by ranges of bytes, through `open_file` where the workers do not mount its file system; without one Spark's
    own reader takes such a file as one value. Rows without a page_ord are numbered densely: their place in their partition behind the sizes of the earlier partitions,
    which are one row a partition.
    """
    listed = None if _is_folder(spark, path) else json_objects(spark, path, open_file)
    if listed is not None:
        page = listed.select("at", F.from_json("value", PAGE_SCHEMA).alias("p"))
        return spread(page.select(F.coalesce("p.page_ord", "at").alias("page_ord"), "p.id", "p.link", "p.modified", "p.content"))
    raw = spark.read.option("multiLine", not _is_folder(spark, path)).schema(PAGE_SCHEMA).json(path)
    at = F.monotonically_increasing_id()
    placed = raw.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1))
    sizes = {r["_part"]: r["n"] for r in placed.where("page_ord is null").groupBy("_part").agg((F.max("_at") + 1).alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    starts = F.create_map(*[F.lit(x).cast("bigint") for pair in first.items() for x in pair]) if first else F.lit(None).cast("map<bigint,bigint>")
    order = F.coalesce("page_ord", F.element_at(starts, F.col("_part")) + F.col("_at"))
    return spread(placed.select(order.alias("page_ord"), "id", "link", "modified", "content"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def fetch_displayed(urls: DataFrame, fetch: Callable[[str], str] | None = None, pause: float | None = None, lanes: int | None = None,
                    store: str | None = None) -> DataFrame:
    """urls(url) -> (url, html) of the pages as displayed; each distinct url is asked for once, a missing one never.

    All urls of a host are in one of `lanes` tasks (one a core by default), which waits `pause` seconds between two requests to the same host.
    With `store`, a folder, pages are kept there: a page that cannot be fetched is reported when all others are kept, and the next call asks for the
    rest alone. Without it the first failure fails the job.
    """
    get = fetch or (lambda url: http_get(url).decode("utf-8", "replace"))
    wait = (PAUSE if fetch is None else 0.0) if pause is None else pause
    spark = urls.sparkSession
    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            for url, host in zip(pdf["url"], pdf["host"]):
                if host == last:
                    time.sleep(wait)
                last, html, problem = host, None, None
                try:
                    html = get(url)
                except Exception as e:
                    if store is None:
                        raise
                    problem = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"url": [url], "html": [html], "problem": [problem]})

    def asked(todo: DataFrame) -> DataFrame:
        host = F.lower(F.regexp_extract("url", HOST, 1)).alias("host")
        lined = todo.select("url", host).repartition(lanes or max(spark.sparkContext.defaultParallelism, 1), "host").sortWithinPartitions("host", "url")
        return lined.mapInPandas(run, SHOWN_SCHEMA)

    if store is None:
        return asked(wanted).select("url", "html")
    kept = read_batches(spark, store, SHOWN_SCHEMA).where("html is not null")
    todo = wanted.join(kept.select("url"), "url", "left_anti")
    if not todo.isEmpty():
        append_batch(asked(todo), store)
    every = read_batches(spark, store, SHOWN_SCHEMA).join(wanted, "url", "left_semi")
    kept = every.where("html is not null")
    lost = every.join(kept.select("url"), "url", "left_anti").groupBy("url").agg(F.max("problem").alias("problem"))
    if not lost.isEmpty():
        first = lost.orderBy("url").first()
        raise RuntimeError(f"{lost.count()} pages were not fetched, the others are kept; {first['url']}: {first['problem']}")
    return kept.dropDuplicates(["url"]).select("url", "html")


def fingerprint(spark: SparkSession, path: str, open_file: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """(file, sha256) for every file of a snapshot, each digested in bounded blocks by one task, whatever its length.

    `open_file` opens a path of the store in a task; without it files of a file system that the workers mount are opened as such.
    Other stores then go through Spark's own reader, which holds a file as one value, refuses one of 2 GB and leaves empty ones out.
    """
    files = spark.read.format("binaryFile").load(path)
    paths = [unquote(p) for p in files.inputFiles()]  # the listing, which the driver holds anyway
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    if open_file is None and not all(p.startswith("file:") for p in paths):
        return files.select(name, F.sha2("content", 256).alias("sha256"))
    get = open_file or open_mounted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "sha256": [_digest(get, p) for p in pdf["path"]]})

    tasks = max(1, min(len(paths), DIGEST_TASKS))
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(tasks).mapInPandas(run, "path string, sha256 string").select(name, "sha256")


def _digest(get: Callable[[str], BinaryIO], path: str) -> str:
    digest = hashlib.sha256()
    with get(path) as stream:
        while block := stream.read(DIGEST_BYTES):
            digest.update(block)
    return digest.hexdigest()
