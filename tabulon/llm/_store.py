"""Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

Operators that need a result more than once, or want to cut lineage, write it there as Parquet
and read it back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.shipping import ship

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session; where none is set, a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabulon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of ``new_path`` on whichever file system it is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder for what one call of an operator needs more than once, deleted when it's done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, new_path(spark, name), 0

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written once and read from there."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written outside of the folder, which is deleted."""
        out = saved(df, name)
        self.drop()
        return out

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores after it where a column is called so, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch where the session doesn't say: what a Python worker holds at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class _Released:
    """A function over batches after which a worker gives freed memory back to the system."""

    def __init__(self, run):
        self.run = run

    def __call__(self, batches):
        yield from self.run(batches)
        _trim()


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, in batches of bounded size."""
    spark = df.sparkSession
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(_Released(run).__call__, schema)


def clear(spark: SparkSession) -> None:
    """Delete all tables and files that operators of this application have written here.

    Results that are still to be read need them, so call it when the work is done.
    """
    drop_path(spark, f"{shared_dir(spark)}/tabulon/{spark.sparkContext.applicationId}")
