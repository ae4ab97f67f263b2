"""Text scans: mesh and labelled-cloud lines as tables. Lines have file, line_no (rising in file order, with gaps) and value.

Files are read by splits, and running counts are kept in two levels: within stretches of `SPAN` line numbers, and over the
counts of whole stretches, so that a large file is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value. A line's number is the first byte of its split plus the lines of the split before it, which
    keeps the order, as no line is shorter than a byte; a file read in other splits has other numbers."""
    meta = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            start = b.column("start").to_numpy()
            file = b.column("file").dictionary_encode()
            code = file.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (code[1:] != code[:-1])]))
            key = (b.column("file")[0].as_py(), int(start[0]))
            own = np.arange(b.num_rows) - np.repeat(first, np.diff([*first, b.num_rows]))
            if key == last:
                own[: first[1] if len(first) > 1 else b.num_rows] += count
            last, count = (b.column("file")[b.num_rows - 1].as_py(), int(start[-1])), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(start + own), b.column("value")], ["file", "line_no", "value"])

    return meta.mapInArrow(number, "file string, line_no long, value string")


def head_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of each file; only first splits are read."""
    first = read_lines(spark, path)
    return first.where(F.col("line_no") < n)


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("t", F.split(F.trim("value"), r"\s+")).withColumn("span", F.floor(F.col("line_no") / SPAN))


def _token(i: int) -> Column:
    return F.get("t", F.lit(i))


def _place() -> list[Column]:
    return [_token(i + 1).cast("double").alias(a) for i, a in enumerate("xyz")]


def _running(rows: DataFrame, flag: Column) -> DataFrame:
    """rows (tokens) with `read`, how many rows of the file up to this one have the flag, and `total`."""
    rows = rows.withColumn("_flag", flag)
    within = Window.partitionBy("file", "span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    spans = rows.groupBy("file", "span").agg(F.count_if("_flag").alias("held"))
    before = F.coalesce(F.sum("held").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("file", "span", before.alias("_before"), F.sum("held").over(whole).alias("total"))
    return rows.withColumn("_own", F.count_if("_flag").over(within)).join(spans, ["file", "span"]).withColumn("read", F.col("_before") + F.col("_own")).drop("_flag", "_own", "_before")


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    """rows (tokens) with `carried`, the last value that is not null up to this row of the file."""
    rows = rows.withColumn("_value", value)
    within = Window.partitionBy("file", "span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy("file", "span").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("line_no"))).alias("held"))
    before = F.last("held", ignorenulls=True).over(Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("file", "span", before.alias("_before"))
    return rows.withColumn("_own", F.last("_value", ignorenulls=True).over(within)).join(spans, ["file", "span"]).withColumn("carried", F.coalesce("_own", "_before")).drop("_value", "_own", "_before")


def obj_vertices(lines: DataFrame, kind: str = "v") -> DataFrame:
    """file, vertex_id (from 0 in file order), x, y, z of the v (or, by kind, vn) lines."""
    v = _running(_tokens(lines).where(_token(0) == kind), F.lit(True))
    return v.select("file", (F.col("read") - 1).cast("long").alias("vertex_id"), *_place())


def obj_faces(lines: DataFrame) -> DataFrame:
    """file, line_no, part, v0, v1, v2 from 0: polygons are cut into a fan; a negative index counts back from the
    vertices read so far; an index out of range is an error."""
    rows = _tokens(lines).where(_token(0).isin("v", "f"))
    f = _running(rows, _token(0) == "v").where(_token(0) == "f")
    number = F.transform(F.slice("t", 2, F.size("t")), lambda x: F.split_part(x, F.lit("/"), F.lit(1)).cast("long"))
    corner = f.select("file", "line_no", "read", "total", number.alias("n")).withColumn("n", F.transform("n", lambda i: F.when(i < 0, F.col("read") + i).otherwise(i - 1)))
    bad = F.exists("n", lambda i: (i < 0) | (i >= F.col("total")))
    corner = corner.withColumn("n", F.when(bad, F.raise_error(F.concat(F.lit("face index out of range in line "), F.col("line_no").cast("string")))).otherwise(F.col("n")))
    fan = corner.where(F.size("n") >= 3).select("file", "line_no", "n", F.explode(F.sequence(F.lit(1), F.size("n") - 2)).alias("part"))
    return fan.select("file", "line_no", "part", F.get("n", F.lit(0)).alias("v0"), F.get("n", F.col("part")).alias("v1"), F.get("n", F.col("part") + 1).alias("v2"))


def whole_meshes(lines: DataFrame) -> DataFrame:
    """file, vertices, faces: how many of each a file has; a file without one of them is an error."""
    counts = _tokens(lines).groupBy("file").agg(F.count_if(_token(0) == "v").alias("vertices"), F.count_if(_token(0) == "f").alias("faces"))
    empty = F.raise_error(F.concat(F.lit("no vertices or no faces in "), "file"))
    return counts.select("file", *[F.when((F.col("vertices") == 0) | (F.col("faces") == 0), empty).otherwise(F.col(c)).cast("long").alias(c) for c in ("vertices", "faces")])


def labelled_points(lines: DataFrame, both: bool = False) -> DataFrame:
    """file, line_no, label (1 flash, 0 body), x, y, z: the last group line before a vertex labels it. With `both`, a file
    without points of one of the labels is an error."""
    name = F.when(F.col("value").startswith("g "), F.lower("value"))
    label = F.when(name.contains("flash"), 1).when(name.contains("body"), 0).when(name.isNotNull(), -1)
    rows = _carried(_tokens(lines), label).withColumnRenamed("carried", "label")
    v = rows.where((_token(0) == "v") & (F.col("label") >= 0)).select("file", "line_no", "label", *_place())
    if not both:
        return v
    seen = v.groupBy("file").agg(F.count_distinct("label").alias("labels"))
    lacking = F.when(F.coalesce("labels", F.lit(0)) < 2, F.raise_error(F.concat(F.lit("flash and body points are needed in "), "file"))).otherwise(F.lit(True))
    files = lines.select("file").distinct().join(seen, "file", "left").select("file", lacking.cast("boolean").alias("_whole"))
    return files.join(v, "file").where("_whole").drop("_whole")


def group_counts(lines: DataFrame, per: int = 8) -> DataFrame:
    """file, name, faces, markers: the f lines after each o line, and how many markers of `per` faces they are."""
    name = F.when(_token(0) == "o", _token(1))
    rows = _carried(_tokens(lines), name).where("carried IS NOT NULL")
    counts = rows.groupBy("file", F.col("carried").alias("name")).agg(F.count_if(_token(0) == "f").alias("faces"))
    return counts.withColumn("markers", F.floor(F.col("faces") / per).cast("long"))


def _ply(lines: DataFrame) -> DataFrame:
    """Body lines with at (from 0 after the header), vertices and edges (as declared)."""
    rows = _tokens(lines)
    declared = lambda what: F.max(F.when((_token(0) == "element") & (_token(1) == what), _token(2).cast("long"))).alias(what)
    ascii_ = F.count_if((_token(0) == "format") & (_token(1) == "ascii")).alias("ascii")
    heads = rows.groupBy("file").agg(F.min(F.when(F.trim("value") == "end_header", F.col("line_no"))).alias("head"), declared("vertex"), declared("edge"), ascii_)
    sound = F.when((F.col("ascii") > 0) & F.col("head").isNotNull(), F.col("head")).otherwise(F.raise_error(F.concat(F.lit("no ASCII header in "), "file")).cast("long"))
    heads = heads.select("file", sound.alias("head"), "vertex", F.coalesce("edge", F.lit(0)).alias("edge"))
    body = rows.join(heads, "file").where("line_no > head AND trim(value) <> ''")
    return _running(body, F.lit(True)).withColumn("at", F.col("read") - 1)


def ply_points(lines: DataFrame) -> DataFrame:
    """file, vertex_id, x, y, z, red, green, blue of ASCII PLY bodies: as many lines after the header as it declares
    vertices; colours are null where a line has none."""
    colours = [_token(i + 3).cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return _ply(lines).where("at < vertex").select("file", F.col("at").cast("long").alias("vertex_id"), *[_token(i).cast("double").alias(a) for i, a in enumerate("xyz")], *colours)


def ply_edges(lines: DataFrame) -> DataFrame:
    """file, edge_id, a, b (vertices from 0) of ASCII PLY bodies; a vertex out of range is an error."""
    rows = _ply(lines).where("at >= vertex AND at < vertex + edge").select("file", "vertex", (F.col("at") - F.col("vertex")).cast("long").alias("edge_id"), _token(0).cast("long").alias("a"), _token(1).cast("long").alias("b"))
    bad = (F.least("a", "b") < 0) | (F.greatest("a", "b") >= F.col("vertex"))
    return rows.select("file", "edge_id", F.when(bad, F.raise_error(F.lit("edge out of range")).cast("long")).otherwise(F.col("a")).alias("a"), "b")


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text (columns line_no, value): range-partitioned by line, so the part files follow each other."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
