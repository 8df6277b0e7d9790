"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LOG_FILES = "spark.sql.streaming.checkpointFileManagerClass"
_PLAIN_LOG_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints; a private one only where the cluster names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _private_folder()


@functools.cache
def _private_folder() -> str:
    """One folder of this process, gone with it."""
    place = tempfile.mkdtemp(prefix="sawlog-checkpoint-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared folder and read back.

    For results that several branches read and that are dear to compute: the lineage ends
    here, a lost executor costs no new parse, and every branch reads only the columns it needs.
    What is below the folder's ``sawlog`` can be removed when the session has ended.
    """
    place = f"{checkpoint_dir(df.sparkSession)}/sawlog/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@contextlib.contextmanager
def plain_checkpoints(spark: SparkSession, place: str) -> Iterator[None]:
    """Streams started within write their logs and state by plain renames, if ``place`` is on a mounted folder.

    What Spark takes by itself there starts several processes for every file it writes, which costs a small micro-batch
    more than its rows. A choice that was made for the session stays, and so do stores that are not mounted.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    mounted = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    if not mounted or spark.conf.get(_LOG_FILES, None) is not None:
        yield
        return
    spark.conf.set(_LOG_FILES, _PLAIN_LOG_FILES)
    try:
        yield
    finally:
        spark.conf.unset(_LOG_FILES)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sawlog")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
