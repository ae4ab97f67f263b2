"""Text scans by splits, and runs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facetry.sources import runs, text


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "8"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_mesh_in_many_splits(spark, tmp_path, splits, monkeypatch):
    monkeypatch.setattr(text, "SPAN", 50)
    lines, faces, n = [], [], 0
    for i in range(120):
        lines += [f"v {i} {i * 0.5} -1", f"vn 0 0 {i}"]
        n += 1
        if i % 5 == 4:
            lines.append("f -1 -2 -3/7 1")
            faces += [(n - 1, n - 2, n - 3), (n - 1, n - 3, 0)]
    for name in ("a.obj", "b.obj"):
        (tmp_path / name).write_text("\n".join([*lines, "o last", ""]))
    got = text.read_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 4
    for _, own in got.toPandas().groupby("file"):
        assert own.sort_values("line_no")["value"].tolist() == [*lines, "o last"] and own["line_no"].is_unique
    v = text.obj_vertices(got).where(F.col("file").endswith("a.obj")).orderBy("vertex_id").collect()
    assert [(r.vertex_id, r.x, r.y) for r in v] == [(i, float(i), i * 0.5) for i in range(120)]
    assert [r.z for r in text.obj_vertices(got, "vn").where(F.col("file").endswith("b.obj")).orderBy("vertex_id").collect()] == [float(i) for i in range(120)]
    f = text.obj_faces(got).where(F.col("file").endswith("a.obj")).orderBy("line_no", "part").collect()
    assert [(r.v0, r.v1, r.v2) for r in f] == faces
    assert {(r.vertices, r.faces) for r in text.whole_meshes(got).collect()} == {(120, 24)}
    assert sorted(r.value for r in text.head_lines(spark, str(tmp_path), 2).collect()) == sorted(lines[:2] * 2)
    (tmp_path / "c.obj").write_text("v 0 0 0\n")
    with pytest.raises(Exception, match="no vertices or no faces"):
        text.whole_meshes(text.read_lines(spark, str(tmp_path / "c.obj"))).collect()


def _lines(spark, values):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(values)], "file string, line_no long, value string")


def test_labels_and_groups(spark, monkeypatch):
    monkeypatch.setattr(text, "SPAN", 3)
    lines = _lines(spark, ["v 9 9 9", "g FLASH one", "v 1 0 0", "v 2 0 0", "x", "y", "z", "v 3 0 0", "g Body", "v 4 0 0", "g other", "v 5 0 0"])
    assert sorted((r.label, r.x) for r in text.labelled_points(lines, both=True).collect()) == [(0, 4.0), (1, 1.0), (1, 2.0), (1, 3.0)]
    with pytest.raises(Exception, match="flash and body points"):
        text.labelled_points(lines.where("line_no < 8"), both=True).collect()
    groups = _lines(spark, ["f 1", "o a", *["f 1 2 3"] * 17, "o b", "v 1 1 1", "o c", "f 1 2 3"])
    assert sorted((r.name, r.faces, r.markers) for r in text.group_counts(groups).collect()) == [("a", 17, 2), ("b", 0, 0), ("c", 1, 0)]


def test_ply(spark):
    head = ["ply", "format ascii 1.0", "comment x", "element vertex 3", "element edge 2", "end_header"]
    lines = _lines(spark, [*head, "0 1 2 9 8 7", "", "3 4 5", "6 7 8 1 2 3", "0 1", "1 2"])
    assert sorted((r.vertex_id, r.x, r.red, r.blue) for r in text.ply_points(lines).collect()) == [(0, 0.0, 9, 7), (1, 3.0, None, None), (2, 6.0, 1, 3)]
    assert sorted((r.edge_id, r.a, r.b) for r in text.ply_edges(lines).collect()) == [(0, 0, 1), (1, 1, 2)]
    with pytest.raises(Exception, match="edge out of range"):
        text.ply_edges(_lines(spark, [*head, "0 1 2", "3 4 5", "6 7 8", "0 3", "1 2"])).collect()
    with pytest.raises(Exception, match="no ASCII header"):
        text.ply_points(_lines(spark, ["ply", "format binary 1.0", "element vertex 1", "end_header", "0 0 0"])).collect()


def test_runs(spark, tmp_path):
    base, at = str(tmp_path), datetime(2026, 1, 2, 3, 4, 5)
    one, two = (runs.new_run(spark, base, "case", at) for _ in range(2))
    later = runs.new_run(spark, base, "case", datetime(2026, 1, 2, 3, 4, 6))
    assert one.endswith("case_20260102_030405") and two.endswith("case_20260102_030405_01")
    assert runs.latest_run(spark, base, "case").endswith(later.rsplit("/", 1)[1]) and len(runs.runs(spark, base, "case")) == 3
    with pytest.raises(FileNotFoundError):
        runs.latest_run(spark, base, "none")
    rows = spark.createDataFrame([(1, [1.5, None], {"k": 2}, "x")], "branch_id int, v array<double>, m map<string,int>, s string")
    runs.write_csv(rows, f"{one}/csv", ["v", "m", "absent", "s"])
    got = spark.read.csv(f"{one}/csv", header=True, escape="\\").first()
    assert (got.v, got.m, got.absent, got.s) == ("1.5;", '{"k":2}', None, "x")
    runs.write_summary(rows.agg(F.count("*").alias("n"), F.collect_list("s").alias("s")), f"{one}/summary")
    assert json.loads(spark.read.text(f"{one}/summary").first()[0]) == {"n": 1, "s": ["x"]}
    runs.write_table(rows, f"{one}/table")
    assert spark.read.parquet(f"{one}/table").count() == 1
    for write in (lambda: runs.write_csv(rows, f"{one}/csv"), lambda: runs.write_summary(rows, f"{one}/summary"), lambda: runs.write_table(rows, f"{one}/table")):
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            write()
    (tmp_path / "set.json").write_text('{"a": {"b": 2}, "c": 3}')
    assert runs.read_settings(spark, f"{base}/set.json", {"a": {"b": 1, "d": 4}, "e": 5}) == {"a": {"b": 2, "d": 4}, "c": 3, "e": 5}
