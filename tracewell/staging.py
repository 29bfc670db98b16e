"""Staged tables: written to the folder that driver and executors share, deleted when the driver ends.

A staged table ends a plan's lineage, so that a lost executor costs a read, and lets many plans read one result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_LIVE: dict[str, tuple] = {}
_SCRATCH = threading.local()
#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS: dict[SparkSession, list] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where none is named and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tracewell-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for one use; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(sweep)
    _LIVE[path] = (spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    return path


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written and read back."""
    path = new_path(df.sparkSession, name)
    for names, made in getattr(_SCRATCH, "open", []):
        if name in names:
            made.append(path)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(*names: str) -> Iterator[None]:
    """What this thread stages meanwhile under these names is deleted at the end."""
    _SCRATCH.open = [*getattr(_SCRATCH, "open", []), (names, made := [])]
    try:
        yield
    finally:
        _SCRATCH.open = _SCRATCH.open[:-1]
        for path in made:
            _delete(path)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Writes leave no shuffle files behind; the session's own setting holds again after the last of those at work."""
    with _LOCK:
        at_work = _WRITERS.setdefault(spark, [0, spark.conf.get(_CLEAN, None)])
        at_work[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            at_work[0] -= 1
            if not at_work[0]:
                spark.conf.unset(_CLEAN) if at_work[1] is None else spark.conf.set(_CLEAN, at_work[1])
                del _WRITERS[spark]


def _delete(path: str) -> None:
    where, conf = _LIVE.pop(path)
    where.getFileSystem(conf).delete(where, True)


def sweep() -> None:
    """Delete all that was staged; frames made from it cannot be read any more."""
    for path in list(_LIVE):
        try:
            _delete(path)
        except Exception as e:  # noqa: BLE001  the gateway may be gone when the driver ends
            warnings.warn(f"{path} is left behind: {e}", stacklevel=2)
            return
