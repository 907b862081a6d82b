"""Shared pieces of the training-data operators.

``staged`` cuts lineage with a written table in the folder that all executors
share; ``arrow_map`` runs a per-row Python codec over Arrow batches with output
batches of bounded size.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STAGED: dict[str, list[str]] = {}
_KEPT: dict[str, object] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, else the folder given to ``setCheckpointDir``, else one beside the warehouse.

    All three are folders that executors share; a machine's own temporary folder is never used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = made.get() if made.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return path.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = staging_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str = "bucket") -> DataFrame:
    """Like ``staged``, but the files are dealt by a hash of ``key``: grouping or joining by it needs no shuffle.

    Rows must already lie in as many partitions by ``key``, or each task writes a file a bucket.
    """
    path = staging_path(df.sparkSession, name)
    table = "kinfold_" + path.rsplit("-", 1)[-1]
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return df.sparkSession.table(table)


def delete(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and nothing reads any more."""
    spark = df.sparkSession
    mine = _STAGED.get(spark.sparkContext.applicationId, [])
    files = df.inputFiles()
    for path in [p for p in mine if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]:
        mine.remove(path)
        spark.sql(f"DROP TABLE IF EXISTS kinfold_{path.rsplit('-', 1)[-1]}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    forget_shuffles(spark)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffles that led to a written table when the driver's collector finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that ``staged`` wrote in this application, oldest first."""
    mine = _STAGED.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(mine) > keep:
        name = mine.pop(0)
        spark.sql(f"DROP TABLE IF EXISTS kinfold_{name.rsplit('-', 1)[-1]}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df`` with a broadcast hint only if the planner's size of it, for a written table its bytes on disk, is at most ``most``.

    Else the planner chooses: adaptive execution knows the size of what has been shuffled.
    """
    return F.broadcast(df) if planned_bytes(df) <= most else df


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: for files their bytes, for what is made of them an upper bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def text_of(col: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): all other columns as one struct, so that no name can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("int")).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns that ``packed`` took, in their order, to select from ``df``."""
    return [df[c] if c in ("doc_id", "text") else df["_row"][c].alias(c) for c in columns]


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does it for pure ASCII; other strings go letter by letter."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


#: Seconds without a task after which a Python worker gives its caches back.
IDLE_S = 2.0
_TASKS = {"running": 0, "ended": 0.0, "watched": False}


def give_back() -> None:
    """Free memory that this worker's allocators keep goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _drop_caches() -> None:
    _KEPT.clear()
    gc.collect()
    give_back()


def _watch() -> None:
    while True:
        time.sleep(IDLE_S / 4)
        if _KEPT and not _TASKS["running"] and time.monotonic() - _TASKS["ended"] > IDLE_S:
            _drop_caches()


@contextlib.contextmanager
def task() -> Iterator[None]:
    """Marks a task as running; caches that no task has used for ``IDLE_S`` seconds are freed.

    An executor's idle workers would otherwise hold them while stages run that need no Python.
    """
    if not _TASKS["watched"]:
        _TASKS["watched"] = True
        threading.Thread(target=_watch, daemon=True).start()
    _TASKS["running"] += 1
    try:
        yield
    finally:
        _TASKS["running"] -= 1
        _TASKS["ended"] = time.monotonic()
        give_back()


def worker_cache(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept for the next tasks of this Python worker.

    One at a time: a worker that goes on with another operator frees the last one's.
    """
    if name not in _KEPT:
        _drop_caches()
        _KEPT[name] = build()
    return _KEPT[name]


def arrow_map(
    df: DataFrame,
    schema: StructType,
    make: Callable[[], Callable[[dict], dict]],
    rows: int = 512,
    through: tuple[str, ...] = (),
) -> DataFrame:
    """Apply ``make()`` (built once a task) to column lists, ``rows`` documents at a time.

    Columns named in ``through`` stay Arrow arrays: they are handed on, not turned into objects.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def column(x, kind: pa.DataType) -> pa.Array:
        return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task():
            work = make()
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    got = work({n: c if n in through else c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                    yield pa.RecordBatch.from_arrays([column(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str, rows: int = 512) -> DataFrame:
    """The rows of ``df`` for which ``make()`` on ``column`` says so; no other column becomes a Python object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task():
            work = make()
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield part.filter(pa.array(work(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
