"""Runs of a job: folders that are never written twice, and the tables, summaries and settings in them.

Folders are made through the file system that Spark reads and writes with, so they may be in any store of its."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "_RUN"


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_run(spark: SparkSession, base: str, name: str, stamp: datetime | None = None) -> str:
    """A new folder base/name_<time>, or with _01, _02 and so on behind it where that is taken. A mark that only one can
    create decides between runs that begin at once."""
    stem = f"{base.rstrip('/')}/{name}_{(stamp or datetime.now()):%Y%m%d_%H%M%S}"
    for i in range(1000):
        path = stem if not i else f"{stem}_{i:02d}"
        system, where = _system(spark, path)
        if system.exists(where):
            continue
        if system.createNewFile(_system(spark, f"{path}/{MARK}")[1]):
            return path
    raise RuntimeError(f"no free folder for {stem}")


def runs(spark: SparkSession, base: str, name: str) -> list[str]:
    """The folders of a name's runs, in order of their names, that is of their times."""
    system, where = _system(spark, f"{base.rstrip('/')}/{name}_*/{MARK}")
    found = system.globStatus(where) or []
    return sorted(s.getPath().getParent().toString() for s in found)


def latest_run(spark: SparkSession, base: str, name: str) -> str:
    found = runs(spark, base, name)
    if not found:
        raise FileNotFoundError(f"no run of {name} in {base}")
    return found[-1]


def read_settings(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """One JSON file of settings over nested defaults."""

    def over(low: dict, high: dict) -> dict:
        return low | {k: over(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}

    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must be one file")
    return over(defaults, json.loads(rows[0][0]))


def _flat(c: str, kind: T.DataType) -> Column:
    """A value that fits a CSV cell: lists of plain values joined by semicolons, all else that is nested as JSON."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
        return F.concat_ws(";", F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("")))).alias(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c).alias(c)
    return F.col(c)


def csv_ready(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows with cells that a CSV file can hold; of `columns` those that rows lack are empty, others are left out."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[_flat(c, kinds[c]) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns or rows.columns])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV parts with a header; a folder that exists is an error."""
    csv_ready(rows, columns).write.mode("errorifexists").csv(path, header=True)


def write_summary(one: DataFrame, path: str) -> None:
    """One row of aggregates as one JSON line; a folder that exists is an error."""
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_table(rows: DataFrame, path: str, by: str = "branch_id") -> None:
    """Parquet with a folder for each value of a column of few values; a folder that exists is an error."""
    rows.write.mode("errorifexists").partitionBy(by).parquet(path)
