"""Readers: discover files, sniff CSV, and scan JSON lines, JSON documents, CSV, Parquet and SQLite.

A file may hold several tables: those in JSON documents are named ``path#key``, those of SQLite files ``path#table``.
"""

from __future__ import annotations

import csv
import fnmatch
import sqlite3
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are skipped, and the most files of one discovery.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv")
MAX_FILES = 5000
HEAD_BYTES = 64 * 1024
DELIMITERS = ",;\t|"
CORRUPT = "_corrupt_record"
KINDS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite"}


def kind_of(path: str) -> str | None:
    """The format that a file's name tells, compression aside."""
    name = PurePosixPath(path).name.lower()
    for end in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(end)
    return KINDS.get(PurePosixPath(name).suffix)


def discover(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path, kind, bytes) of the readable files under ``root``, by path, through the file system that holds it."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [base]
    while todo:
        for s in sorted(fs.listStatus(todo.pop()), key=lambda s: s.getPath().toString()):
            path = s.getPath()
            if s.isDirectory():
                if path.getName() in SKIPPED:
                    continue
                if path.getName().endswith(".parquet"):
                    found.append((path.toString(), "parquet", 0))
                else:
                    todo.append(path)
            elif kind_of(path.getName()):
                found.append((path.toString(), kind_of(path.getName()), s.getLen()))
            if len(found) > MAX_FILES:
                raise ValueError(f"more than {MAX_FILES} files under {root}")
    return sorted(found)


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> str:
    """The first bytes of a file as text, decompressed as Spark would."""
    lines, held = [], 0
    for row in spark.read.text(path).limit(200).toLocalIterator():
        lines.append(row[0])
        held += len(row[0]) + 1
        if held >= size:
            break
    return "\n".join(lines)


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits the first lines into the most equal numbers of cells; a comma if none does."""
    lines = [x for x in sample.split("\n")[:50] if x.strip()]
    best, score = ",", (0, 0)
    for d in DELIMITERS:
        widths = [len(r) for r in csv.reader(lines, delimiter=d)]
        if widths and widths[0] > 1:
            got = (sum(w == widths[0] for w in widths), widths[0])
            if got > score:
                best, score = d, got
    return best


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of JSON lines, gzipped or not; a line that does not parse keeps its text in ``_corrupt_record``.

    A gzipped file is one task's work to read; ``partitions`` deals its rows out for what follows.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        reader = reader.schema(struct if CORRUPT in struct.names else T.StructType([*struct.fields, T.StructField(CORRUPT, T.StringType())]))
    df = reader.json(path)
    return df.repartition(partitions) if partitions else df


def bad_lines(df: DataFrame) -> DataFrame:
    """The lines of :func:`read_jsonl` that did not parse."""
    return df.where(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else df.limit(0)


def read_json(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The rows of a JSON array, or of the array under ``key`` of a JSON object."""
    df = spark.read.option("multiLine", True).json(path)
    return df if key is None else df.select(F.explode(key).alias("row")).select("row.*")


def json_tables(spark: SparkSession, path: str) -> list[str | None]:
    """The keys of a JSON object under which arrays of objects stand; [None] for an array."""
    schema = spark.read.option("multiLine", True).json(path).schema
    keys = [f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    return keys or [None]


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Rows of a file with a header, all columns text; empty cells are null."""
    return spark.read.csv(path, header=True, sep=sep or sniff_delimiter(head(spark, path)), nullValue="", multiLine=False, escape='"')


class _RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Reads a table read-only, in ranges of rowid where it has one."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.parts = int(options.get("numpartitions", 8))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [_RowRange(0, -1)]
        if low is None:
            return [_RowRange(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _RowRange) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        where = f" WHERE rowid >= {partition.low} AND rowid < {partition.high}" if partition.high >= 0 else ""
        casts = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}
        makes = [casts[type(f.dataType)] for f in self.schema]
        with self._open() as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}"{where}'):
                yield tuple(None if v is None else make(v) for v, make in zip(row, makes, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("dbtable", table)``.  The file must be where the tasks run."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info(\"{self.options['dbtable']}\")").fetchall()
        return T.StructType([T.StructField(c[1], _sqlite_type(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def _sqlite_type(declared: str) -> T.DataType:
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY 1")]


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("dbtable", table).load(path)


def read_any(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """One table of a file of any known kind."""
    kind = kind_of(path)
    if kind == "jsonl":
        return read_jsonl(spark, path)
    if kind == "json":
        return read_json(spark, path, table)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "sqlite":
        return read_sqlite(spark, path.removeprefix("file:"), table or sqlite_tables(path.removeprefix("file:"))[0])
    raise ValueError(f"no reader for {path}")


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table under ``root`` by its name relative to it."""
    out: dict[str, DataFrame] = {}
    base = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toString()
    for path, kind, _ in discover(spark, root):
        name = path.removeprefix(base).lstrip("/")
        if kind == "json":
            out |= {name if k is None else f"{name}#{k}": read_json(spark, path, k) for k in json_tables(spark, path)}
        elif kind == "sqlite":
            local = path.removeprefix("file:")
            out |= {f"{name}#{t}": read_sqlite(spark, local, t) for t in sqlite_tables(local)}
        else:
            out[name] = read_any(spark, path)
    return out


def matching(found: dict[str, DataFrame], pattern: str) -> dict[str, DataFrame]:
    """The tables whose names fit a glob."""
    return {k: v for k, v in found.items() if fnmatch.fnmatch(k, pattern)}
