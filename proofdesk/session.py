"""Session defaults and the two guards every plan shares: bounded broadcast and lineage cuts."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its real row count and byte size were measured under these limits.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20
SPREAD_BYTES_PER_CORE = 4 << 20
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "proofdesk", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings such as master and memory stay the submitter's."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship_package(b.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Put this package on the Python path of the session's workers; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_proofdesk_shipped", None) is None:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="proofdesk-"), "proofdesk.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(archive)
        sc._proofdesk_shipped = archive
    return spark


def row_bytes(df: DataFrame):
    """Bytes of a row: 8 for a fixed-width column, the length of a string or binary one, the JSON text of a nested one."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            size = F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            size = F.lit(8)
        total = total + size
    return total


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Measure `df`, rows and bytes of all its columns, against the broadcast limits."""
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    row = df.select(row_bytes(df).cast("bigint").alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, **limits) -> DataFrame:
    """Broadcast hint when measured small; otherwise unhinted, so the join shuffles and AQE splits skew."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def bounded_blocks(df: DataFrame, key: str, payload: str, max_rows: int, max_bytes: int) -> Iterator[tuple[list, int]]:
    """Bounded lists of rows, and how many there are. One block normally; else blocks by hash of `key`, sized from measured rows and bytes of `payload`."""
    size = F.octet_length(F.col(payload).cast("string")).cast("bigint")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n // max_rows), -(-total // max_bytes))
    blocks = 2 * blocks if blocks > 1 else 1
    for i in range(blocks):
        rows = (df if blocks == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)).collect()
        if rows:
            yield rows, blocks


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core before heavy per-row work.

    A few small files or one row group would otherwise keep most cores idle. Decided on the planner's size
    estimate, so it runs nothing, and an input of more than a few MB per core keeps its scan partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster shares; only a local master may go without naming one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="proofdesk-ckpt-"))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`, else the one set on the context; one of our own only on a local master without either."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="llm-tables-")
    return _LOCAL_DIRS[sc.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as a compressed table in the shared folder and read it back.

    The committed files survive lost executors. They stay until the shared folder is emptied, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
