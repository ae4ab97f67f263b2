"""Geometry views over the embeddings and events tables, in Spark and as DuckDB CTEs of the same names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import named, unit


def _e(i: int) -> Column:
    return F.element_at("embedding", i).cast("double")


def _three(first: int) -> tuple[Column, Column, Column]:
    return _e(first), _e(first + 1), _e(first + 2)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("point_index"), F.col("label").alias("branch_id"), seq.cast("long").alias("seq"), *named(_three(1)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("point_index").over(Window.partitionBy("branch_id").orderBy("seq"))
    return points(spark, sf_dir).select(F.col("point_index").alias("a"), after.alias("b")).where("b IS NOT NULL")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, u, w = _three(4), _three(7), _three(10)
    b, c = (tuple(p + 0.2 * q for p, q in zip(a, d, strict=True)) for d in (u, w))
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("face_id"), *named(a, "a"), *named(b, "b"), *named(c, "c"))


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("point_index"), *named(unit(_three(13)), "n"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 2).cast("int").alias("label"), *named(_three(16)))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    n = e.agg(F.count("*")).scalar()
    v = [((F.col("vec_id") + i) % n).alias(f"v{i}") for i in range(3)]
    return e.select(F.col("vec_id").alias("face_id"), *v)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", order.cast("long").alias("seq"), "event_type", "value")


def _sql3(first: int, prefix: str = "") -> str:
    return ", ".join(f"CAST(embedding[{first + i}] AS DOUBLE) AS {prefix}{a}" for i, a in enumerate("xyz"))


CTES = f"""
g_points AS (SELECT vec_id AS point_index, label AS branch_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, {_sql3(1)} FROM embeddings),
g_edges AS (SELECT * FROM (SELECT point_index AS a, lead(point_index) OVER (PARTITION BY branch_id ORDER BY seq) AS b FROM g_points) WHERE b IS NOT NULL),
g_raw AS (SELECT vec_id AS face_id, {_sql3(4, 'a')}, {_sql3(7, 'u')}, {_sql3(10, 'w')} FROM embeddings),
g_tris AS (SELECT face_id, ax, ay, az, ax + 0.2e0 * ux AS bx, ay + 0.2e0 * uy AS by, az + 0.2e0 * uz AS bz, ax + 0.2e0 * wx AS cx, ay + 0.2e0 * wy AS cy, az + 0.2e0 * wz AS cz FROM g_raw),
g_nraw AS (SELECT vec_id AS point_index, {_sql3(13, 'm')} FROM embeddings),
g_normals AS (SELECT point_index, mx / n AS nx, my / n AS ny, mz / n AS nz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS n FROM g_nraw)),
g_cloud AS (SELECT vec_id AS point_id, CAST(vec_id % 2 AS INTEGER) AS label, {_sql3(16)} FROM embeddings),
g_topo AS (SELECT vec_id AS face_id, vec_id % n AS v0, (vec_id + 1) % n AS v1, (vec_id + 2) % n AS v2 FROM embeddings, (SELECT count(*) AS n FROM embeddings)),
e_seq AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, value FROM events)
"""


def with_views(sql: str) -> str:
    """A query, or CTEs and a query after them, over the views."""
    return re.sub(r"\bby\b", '"by"', f"WITH RECURSIVE {CTES}{sql}")  # the column; keywords are in capitals
