"""What the operators of this subpackage share: reading tables, stored intermediates, task helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklore.session import ensure_checkpoint_dir, write_parquet

#: White space that separates words in every contract of this subpackage: ASCII blank and \t to \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast up to this many rows, each of a few numbers and short strings; beyond it the join shuffles.
BROADCAST_ROWS = 10_000

#: Rows of an Arrow batch that a task works on at once.
SLICE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder below the shared checkpoint folder, and read back.

    Cuts the lineage like ``checkpoint()``; the columnar file is several times smaller. A lost
    executor costs nothing: the files are outside the executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stores tables like ``stored`` and empties their folders with ``clear``, once nothing reads them any more.

    Emptied by overwriting with an empty table, so it works wherever Spark can write.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        write_parquet(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.paths = []


def spread(df: DataFrame, column: str) -> DataFrame:
    """``df`` dealt by a column to all shuffle partitions; for narrow rows that are exploded many times next.

    The number is stated, so that the optimizer does not join partitions that are small before the explosion.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` (narrow rows, already stored) has at most ``rows`` rows, else ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Like ``small``, but beyond the bound the join sorts both sides, however small Spark takes the files of ``df`` to be."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def with_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], new: dict[str, str],
               read: list[str], keep: list[str], state: bool = False) -> DataFrame:
    """Columns ``keep`` of ``df`` and the new columns that ``fn`` makes of columns ``read``, batch by batch.

    ``fn`` gets a record batch with the columns ``read`` in that order and returns one list or
    Arrow array per new column. ``new``: column name to Spark type. Inside, the columns have
    positional names, so columns of ``df`` with clashing names do no harm. ``state``: ``fn`` uses ``of_worker``; else what
    earlier operators left there is given up first, so that workers of long sessions stay small.
    """
    inner = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                      *[F.col(c).alias(f"r{i}") for i, c in enumerate(read)])
    n = len(keep)
    probe = inner.limit(0).select(*[f"k{i}" for i in range(n)],
                                  *[F.lit(None).cast(t).alias(f"n{i}") for i, t in enumerate(new.values())])
    schema, names = probe.schema, [f"n{i}" for i in range(len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            _worker_state().clear()
            _trim()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):      # bounds what a task holds at once
                batch = whole.slice(at, SLICE)
                made = fn(batch.select(range(n, batch.num_columns)))
                cols = [batch.column(i) for i in range(n)] + [
                    x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]
                yield pa.RecordBatch.from_arrays(cols, names=[f"k{i}" for i in range(n)] + names)
                del cols, made, batch
        _trim()

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      *[F.col(f"n{i}").alias(c) for i, c in enumerate(new)])


def matrix_sum(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that ``part`` gives for the batches of ``df``; zeros without rows.

    Summed within each partition first; the numbers of one matrix are all that reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                total += part(whole.slice(at, SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    parts = df.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros(shape)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = v
    return out


def _worker_state() -> dict:
    """Task functions travel by value, so their own globals are new in each task; this lives in a module of the worker itself."""
    return sys.modules.setdefault("sparklore_worker_state", ModuleType("sparklore_worker_state")).__dict__


def of_worker(key, make: Callable[[], object]):
    """What ``make`` gives, made once per Python worker for the latest ``key``."""
    kept = _worker_state()
    if kept.get("key") != key:
        kept["key"], kept["made"] = key, make()
    return kept["made"]


def _trim() -> None:
    """Give freed memory back to the system: workers live on after a task, beside those of the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
