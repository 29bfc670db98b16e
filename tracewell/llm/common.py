"""Helpers shared by the operators: staged tables, size-checked joins, held-out folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []

#: Rows that may be broadcast when each row is one or two integers (about 32 MB).
BROADCAST_ROWS = 1_000_000


#: Staged tables not yet deleted: path -> the file system's path and its configuration.
_LIVE: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tracewell-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return _OWN_DIR[0]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted at the end of the driver, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/tracewell-{name}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(sweep)
    _LIVE[path] = (spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    return path


def _delete(path: str) -> None:
    where, conf = _LIVE.pop(path)
    where.getFileSystem(conf).delete(where, True)


def sweep(but: tuple[str, ...] = ()) -> None:
    """Delete all staged tables but those at the paths ``but``: nothing that was made from them can be read again."""
    for path in [p for p in _LIVE if p not in but]:
        try:
            _delete(path)
        except Exception as e:  # noqa: BLE001  the gateway may be gone when the driver ends
            warnings.warn(f"{path} is left behind: {e}", stacklevel=2)
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than a re-read."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path in _LIVE:
            _delete(path)


@contextmanager
def scratch(*kept: DataFrame) -> Iterator[Callable[[DataFrame], None]]:
    """Deletes at its end the tables that were staged within, but those handed to the function it gives."""
    before = set(_LIVE)
    spared = {getattr(df, "_staged_at", None) for df in kept}
    yield lambda df: spared.add(getattr(df, "_staged_at", None))
    for path in [p for p in _LIVE if p not in before and p not in spared]:
        _delete(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the checked row count allows it; else a shuffled join, which
    adaptive execution splits where a key is hot."""
    return F.broadcast(df) if small(df, rows) else df


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``."""
    return docs.join(maybe_broadcast(ids.select(id_col).distinct()), id_col, "left_anti").select(*docs.columns)


#: The column of ``numbered``.
ROW = "tracewell_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, staged, with a number for each row: ids may be null or repeated."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


#: Rows of an Arrow batch; Spark's default of 10,000 long texts would cost each task tens of megabytes, several times.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's Arrow batches to BATCH_ROWS rows.

    Spark takes the size from the session when a plan is made, at the action; so the setting stays, which
    changes no result.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def slices(batch, column: int = 1, max_bytes: int = 4 << 20, max_rows: int = 2000):
    """``batch`` cut into runs of rows whose texts hold about ``max_bytes``; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < n:
        to = max(at + 1, min(int(np.searchsorted(sizes, done + max_bytes, side="right")), at + max_rows))
        yield batch.slice(at, to - at)
        at, done = to, int(sizes[to - 1])


def filter_rows(docs: DataFrame, start, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, less the rows that ``start()(texts)``, a list of booleans, rejects.

    ``start`` is called once per task.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        keep = start()
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 in the order of ``order``: rows are dealt by ranges, sorted
    within them and staged; a running sum over the partitions' sizes (one row each) does the rest."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stage(placed, "ranked")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    out = out.withColumn("rank", F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", "place")
    out._staged_at = placed._staged_at
    return out
