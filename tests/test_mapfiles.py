"""Attribute tables and shapefiles: what is written comes back, and what isn't whole has a defined result."""

import datetime
import struct

import numpy as np
import pytest

from townhall.sources import mapfiles as M

ROWS = [(1, "Āb", 1.5, True, datetime.date(2024, 2, 29)), (-2, None, None, None, None), (3, "", -0.1, False, datetime.date(1, 1, 1))]
SCHEMA = "n long, s string, f double, ok boolean, day date"


@pytest.fixture
def dbf(spark):
    M.register(spark)
    return lambda path, **options: spark.read.format("dbf").options(**options).load(str(path))


def write(spark, rows, path, schema=SCHEMA, format="dbf", files=1):
    M.register(spark)
    spark.createDataFrame(rows, schema).repartition(files).write.format(format).option("encoding", "utf-8").option("width", 30).mode("append").save(str(path))


def test_round_trip(spark, dbf, tmp_path):
    rows = ROWS * 20
    write(spark, rows, tmp_path / "t", files=3)
    back = dbf(tmp_path / "t", encoding="utf-8", recordsPerPartition=7)
    assert back.schema.simpleString() == "struct<n:bigint,s:string,f:double,ok:boolean,day:date>"
    blank = [(n, s or "", f, ok, day) for n, s, f, ok, day in rows]  # a table has no nulls for texts
    assert sorted(map(tuple, back.collect()), key=str) == sorted(blank, key=str)
    assert back.rdd.getNumPartitions() >= 9
    assert not (tmp_path / "t" / "_pending").exists()


def test_what_is_not_whole(spark, dbf, tmp_path):
    write(spark, ROWS, tmp_path / "t")
    (file,) = (tmp_path / "t").glob("*.dbf")
    whole = file.read_bytes()
    first = struct.unpack_from("<H", whole, 8)[0]
    size = struct.unpack_from("<H", whole, 10)[0]
    file.write_bytes(whole[: first + 2 * size + 5])
    assert dbf(file, encoding="utf-8").count() == 2  # two whole records and a piece
    file.write_bytes(whole[:first] + b"*" + whole[first + 1 :])
    assert dbf(file, encoding="utf-8").count() == 2  # one is deleted
    file.write_bytes(whole[:first])
    assert dbf(file).count() == 0
    for cut in (b"", whole[:20], whole[:60]):
        file.write_bytes(cut)
        assert spark.read.format("dbf").schema("n long").load(str(file)).count() == 0
        with pytest.raises(Exception, match="whole header"):
            dbf(file).count()


def test_odd_values(spark, dbf, tmp_path):
    fields = [(b"A", b"N", 5, 0), (b"B", b"N", 6, 2), (b"C", b"L", 1, 0), (b"D", b"D", 8, 0), (b"E", b"M", 10, 0), (b"F", b"I", 4, 0), (b"G", b"N", 20, 0)]
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 9, 32 * len(fields) + 33, size) + b"".join(struct.pack("<11sc4xBB14x", *f) for f in fields) + b"\r"
    rows = [b" " + b"*****" + b"  1.25" + b"?" + b"20240230" + b"0000000001" + struct.pack("<i", -7) + b"12345678901234567890", b" " + b"\0\0\0\0\0" + b"x" * 6 + b"t" + b"20240229" + b" " * 10 + struct.pack("<i", 7) + b" " * 20]
    (tmp_path / "a.DBF").write_bytes(head + b"".join(rows) + b"\x1a")
    got = [tuple(r) for r in dbf(tmp_path).collect()]
    assert got == [(None, 1.25, None, None, None, -7, 12345678901234567890), (None, None, True, datetime.date(2024, 2, 29), None, 7, None)]


def test_writer_refuses(spark, tmp_path):
    for rows, schema, match in (([("x" * 31,)], "s string", "30 bytes"), ([(1,)], "elevenbytes long", "ten bytes"), ([([1],)], "a array<int>", "named geom")):
        with pytest.raises(Exception, match=match):
            write(spark, rows, tmp_path / "t", schema)
    assert not list(tmp_path.rglob("*.dbf"))


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def xy(geom):
    return None if geom is None else [[[(p["x"], p["y"]) for p in r] for r in polygon] for polygon in geom]


def test_shapes(spark, tmp_path):
    """Holes go to the least border around them, whatever way rings went when they were written."""
    outer, inner = ring((0, 0), (0, 10), (10, 10), (10, 0)), ring((4, 4), (4, 6), (6, 6), (6, 4))
    hole, island = ring((2, 2), (8, 2), (8, 8), (2, 8)), ring((4.5, 4.5), (5.5, 4.5), (5.5, 5.5), (4.5, 5.5))
    rows = [(1, [[outer, hole], [inner, island]]), (2, None), (3, [[outer[::-1]]]), (4, [])]
    write(spark, rows, tmp_path / "s", "id long, geom array<array<array<struct<x:double,y:double>>>>", "shapefile")
    got = {r["id"]: xy(r["geom"]) for r in spark.read.format("shapefile").option("recordsPerPartition", 1).load(str(tmp_path / "s")).collect()}
    assert got == {1: xy([[outer, hole], [inner, island]]), 2: None, 3: xy([[outer]]), 4: []}
    (shp,) = (tmp_path / "s").glob("*.shp")
    shp.write_bytes(shp.read_bytes()[:200])  # the first shape isn't whole any more
    cut = {r["id"]: r["geom"] for r in spark.read.format("shapefile").load(str(tmp_path / "s")).collect()}
    assert cut == {1: None, 2: None, 3: None, 4: None}
    next((tmp_path / "s").glob("*.shx")).unlink()
    assert spark.read.format("shapefile").load(str(tmp_path / "s")).filter("geom is null").count() == 4


def test_shapes_with_heights_and_others():
    square = np.array([(0, 0), (0, 1), (1, 1), (0, 0)], dtype="<f8")
    body = struct.pack("<4dii", 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + square.tobytes()
    assert [r.tolist() for r in M.rings_of(struct.pack("<i", 15) + body + b"\0" * 48)] == [square.tolist()]
    assert M.rings_of(struct.pack("<i", 1) + body) is None  # a point
    assert M.rings_of(struct.pack("<i", 5) + body[:-1]) is None
    assert len(M.nested([square[::-1]])) == 1  # a hole in nothing is a border


def test_runs_are_bounded(spark, dbf, tmp_path, monkeypatch):
    """Short runs of a large table become longer ones: tasks don't grow with the records."""
    write(spark, [(i, f"s{i}", i / 2, True, None) for i in range(500)], tmp_path / "t", files=3)
    monkeypatch.setattr(M, "MOST_RUNS", 20)
    runs = M.TableReader(SCHEMA, {"path": str(tmp_path / "t"), "recordsperpartition": "2"}).partitions()
    assert len(runs) <= 20 + 3 and sum(r.count for r in runs) == 500
    assert len(M.TableReader(SCHEMA, {"path": str(tmp_path / "t"), "recordsperpartition": "100"}).partitions()) == 6
    assert sorted(r["n"] for r in dbf(tmp_path / "t", recordsPerPartition=2).collect()) == list(range(500))
