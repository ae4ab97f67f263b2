"""Helpers shared by the corpus operators: staged tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that the words of a text are split at: space and \t \n \v \f \r. bytes.split() uses the same set.
SPACES = r"[\x20\x09-\x0D]"
#: Most rows of one long column that are broadcast (about 100 MB when hashed).
BROADCAST_ROWS = 2_000_000

#: A key that fills more than one in so many rows is heavy; a table has fewer heavy keys than this.
HEAVY = 1000

#: The paths that `staged` notes down for whoever cleans up.
_owner: ContextVar[list[str] | None] = ContextVar("facetry_staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, one is made for a local
    session, which has one machine; on a cluster that would be a folder that executors do not see, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that later plans neither repeat its work nor depend
    on executors that may be lost. The table belongs to the `cleanup` around the call, if there is one."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/facetry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _owner.get()) is not None:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that `staged` returned and that nothing reads any more."""
    for t in tables:
        deleted(t.sparkSession, t.staged_path)


@contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were staged inside, and no others; write the results before that."""
    mine: list[str] = []
    token = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(token)
        for path in mine:
            deleted(spark, path)


def joined_to_counted(left: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of left with counted, which has each key once and, as n, how many rows of left have it. Heavy keys
    (fewer than `HEAVY`, as each fills more than one in `HEAVY` rows of left) are broadcast and their rows of left stay
    where they are; only the others are shuffled. Read left and counted from written tables."""
    heavy = F.col("n") * HEAVY > left.count()
    some = F.broadcast(counted.where(heavy).drop("n"))
    rest = left.join(F.broadcast(counted.where(heavy).select(*keys)), keys, "left_anti")
    return left.join(some, keys).unionByName(rest.join(counted.where(~heavy).drop("n"), keys))


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def row_numbers(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that tells its rows apart and is the same in each scan, however the scan is split:
    the number of the row's file (files are counted in order of their paths, one short row each) and the row's place in
    the file. A table that is not a plain scan of files is staged first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = staged(docs)
    meta, path = docs.metadataColumn("_metadata"), own_name(docs, "facetry_path")
    placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(name))
    files = placed.select(path).distinct()
    files = staged(files.select(path, F.row_number().over(Window.orderBy(path)).cast("long").alias("file")).select(path, F.shiftleft("file", 40).alias("facetry_file")))
    files = F.broadcast(files) if files.count() <= BROADCAST_ROWS // 10 else files
    out = placed.join(files, path)
    return out.select(*[docs[c] for c in docs.columns], (files["facetry_file"] + placed[name]).alias(name))


def only_kept(docs: DataFrame, kept: Callable[[DataFrame, str], DataFrame], limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs whose number is among kept(docs with row numbers, name of the number's column). Rows have
    numbers of their own, so ids may repeat or be missing. The numbers to drop are counted first: up to `limit` they are
    broadcast and the texts stay where they are; beyond it both sides are shuffled."""
    row = own_name(docs, "facetry_row")
    rows = row_numbers(docs, row)
    gone = staged(rows.select(row).join(kept(rows, row).select(row), row, "left_anti"))
    return rows.join(F.broadcast(gone) if gone.count() <= limit else gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """At most so many rows in a batch that goes to a Python worker: texts are long, and what a worker holds is a batch.
    Every operator of this package stages a table first and so sets it for its session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller batches for what is written inside; the session's own size is set again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def packed(rows: DataFrame) -> DataFrame:
    """rows with column text as compressed bytes, which keeps the shuffles of whole texts small; `unpacked` undoes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=3)
        for b in batches:
            small = pa.array([tight.compress(t.as_buffer()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([small if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else t}" for c, t in rows.dtypes))


def unpacked(text: bytes) -> str:
    return zstandard.decompress(text).decode()
