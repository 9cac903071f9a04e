"""Attribute tables (.dbf) and shapefiles (.shp with .shx and .dbf) as Spark sources and sinks.

    register(spark)
    spark.read.format("dbf").load(path)          # the columns of the table
    spark.read.format("shapefile").load(path)    # the same, and geom: polygons > rings > points
    df.write.format("dbf").option("width", 40).mode("append").save(path)

Records of a table have one size, and so have the index entries of a shapefile, so one file is read by as many tasks as it
has runs of records; each reads its own bytes only. A path is a file or a folder of such files; columns are those of
the first file, and a column that another file lacks is null there. Paths are what pyarrow opens: local and mounted ones, and its
file systems by their prefix.

What isn't whole: a file without a whole header has no records, and a folder (or file) in which none has a header no
columns, which is an error unless a schema is given; a file that ends early has its whole records; a shape that ends
early, and one that isn't a polygon, has a null geometry. Deleted records are left out. Numbers, dates and flags that
can't be read are null, as blank ones are.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Polygons > rings > points, as the spatial operators take them.
GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
#: Bytes of records that a task reads, and records of a batch.
PART_BYTES, BATCH = 64 << 20, 10_000
#: Runs that recordsPerPartition makes of all files at most; where there would be more, runs are longer, up to PART_BYTES.
MOST_RUNS = 200
#: Records of a file that a task writes; it holds so many.
FILE_RECORDS = 200_000
HEADER, ENTRY = 100, 8
#: Types of shapes with rings: plain, with heights, with measures. Fixed values.
POLYGONS = (5, 15, 25)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _read(path: str, first: int = 0, size: int | None = None) -> bytes:
    system, inner = _at(path)
    with system.open_input_file(inner) as f:
        f.seek(min(first, f.size()))
        return f.read(size)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """The files of a path with a suffix, in any case, with their sizes."""
    system, inner = _at(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, allow_not_found=False))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(suffix))


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int
    first: int

    def type(self) -> T.DataType:
        if self.kind == "N" and not self.decimals:
            return T.LongType() if self.size <= 18 else T.DecimalType(38, 0) if self.size <= 38 else T.DoubleType()
        return {"N": T.DoubleType(), "F": T.DoubleType(), "O": T.DoubleType(), "I": T.IntegerType(), "D": T.DateType(), "L": T.BooleanType()}.get(self.kind, T.StringType())


@dataclass
class Layout:
    """Where the records of a table are: their number, the first one's place, their size, and their fields."""

    count: int
    first: int
    size: int
    fields: list[Field]


def layout(path: str, size: int) -> Layout | None:
    """The layout of a table of so many bytes; None without a whole header."""
    head = _read(path, 0, 32)
    if len(head) < 32:
        return None
    count, first, width = struct.unpack_from("<IHH", head, 4)
    raw = _read(path, 32, first - 32)
    if width < 1 or len(raw) < first - 32:
        return None
    fields, at = [], 1
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        name = raw[k : k + 11].split(b"\0")[0].decode("latin-1").strip()
        kind, length, decimals = chr(raw[k + 11]), raw[k + 16], raw[k + 17]
        if kind == "C":  # long texts keep the rest of their length where others have decimals
            length, decimals = length + 256 * decimals, 0
        fields.append(Field(name, kind, length, decimals, at))
        at += length
    return Layout(min(count, max(0, size - first) // width), first, width, fields) if at <= width else None


def _number(raw: bytes, whole: bool):
    text = raw.replace(b"\0", b"").strip()
    try:
        return int(text) if whole else float(text)
    except ValueError:
        return None


def _value(field: Field, kind: T.DataType, raw: bytes, encoding: str):
    if field.kind == "I":
        return struct.unpack("<i", raw)[0] if len(raw) == 4 else None
    if isinstance(kind, T.StringType):
        return None if field.kind in "MGPB" else raw.rstrip(b"\0 ").decode(encoding, "replace")
    if isinstance(kind, T.BooleanType):
        return True if raw in (b"T", b"t", b"Y", b"y") else False if raw in (b"F", b"f", b"N", b"n") else None
    if isinstance(kind, T.DateType):
        try:
            return datetime.date(int(raw[:4]), int(raw[4:6]), int(raw[6:8]))
        except ValueError:
            return None
    n = _number(raw, isinstance(kind, (T.LongType, T.IntegerType, T.DecimalType)))
    if isinstance(kind, T.DecimalType):
        import decimal

        return None if n is None else decimal.Decimal(n)
    return n


@dataclass
class Run(InputPartition):
    """A run of records of one file."""

    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.encoding = schema, options["path"], options.get("encoding", "latin-1")
        self.run = int(options.get("recordsperpartition", 0))

    def partitions(self) -> list[InputPartition]:
        out, tables = [], [(path, of) for path, size in _files(self.path, ".dbf") if (of := layout(path, size)) is not None]
        least = -(-sum(of.count for _, of in tables) // MOST_RUNS)
        for path, of in tables:
            most = max(1, PART_BYTES // of.size)
            run = max(self.run, min(least, most)) if self.run else most
            out += [Run(path, k, min(run, of.count - k)) for k in range(0, of.count, run)]
        return out or [Run("", 0, 0)]

    def columns(self, of: Layout, raw: bytes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Which records aren't deleted, and the columns of those."""
        n = len(raw) // of.size
        live = np.array([raw[k * of.size : k * of.size + 1] != b"*" for k in range(n)], dtype=bool)
        starts = (np.flatnonzero(live) * of.size).tolist()
        by_name = {f.name: f for f in of.fields}
        out = {}
        for column in self.schema:
            if isinstance(column.dataType, T.ArrayType):
                continue
            f, arrow = by_name.get(column.name), _arrow(column.dataType)
            out[column.name] = pa.nulls(len(starts), arrow) if f is None else pa.array([_value(f, column.dataType, raw[s + f.first : s + f.first + f.size], self.encoding) for s in starts], arrow)
        return live, out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        size = _at(partition.path)[0].get_file_info(_at(partition.path)[1]).size
        of = layout(partition.path, size)
        for k in range(partition.first, partition.first + partition.count, BATCH):
            raw = _read(partition.path, of.first + k * of.size, min(BATCH, partition.first + partition.count - k) * of.size)
            live, columns = self.columns(of, raw)
            yield from self.batches(partition.path, k, live, columns)

    def batches(self, path: str, first: int, live: np.ndarray, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([columns[c.name] for c in self.schema], self.schema.names)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(38, 0)
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}[kind.simpleString()]


class TableSource(DataSource):
    """Tables of fixed-size records (.dbf). Options: encoding; recordsPerPartition (more, where that made over MOST_RUNS); for writing, width of texts."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> T.StructType:
        for path, size in _files(self.options["path"], ".dbf"):
            if (of := layout(path, size)) is not None:
                return T.StructType([T.StructField(f.name, f.type()) for f in of.fields])
        raise ValueError(f"no table with a whole header at {self.options['path']}; give a schema to read none")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TableReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return TableWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def rings_of(content: bytes) -> list[np.ndarray] | None:
    """The rings of a shape's content, each as points; None for what is no polygon or not whole."""
    if len(content) < 44 or struct.unpack_from("<i", content)[0] not in POLYGONS:
        return None
    parts, points = struct.unpack_from("<ii", content, 36)
    if parts < 0 or points < 0 or len(content) < 44 + 4 * parts + 16 * points:
        return None
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    xy = np.frombuffer(content, dtype="<f8", count=2 * points, offset=44 + 4 * parts).reshape(-1, 2)
    if any(not 0 <= a <= b for a, b in zip(starts[:-1], starts[1:], strict=True)):
        return None
    return [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a]


def turn(ring: np.ndarray) -> float:
    """Twice the area that a ring goes around; negative if it goes clockwise."""
    x, y = (ring - ring[0]).T
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
    up = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((up & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).sum() % 2)


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons: those that go clockwise are borders, each other one is a hole of the least border that holds
    most of its points; a hole in no border is a border itself."""
    borders = [r for r in rings if turn(r) <= 0]
    polygons = [[r] for r in borders]
    for hole in (r for r in rings if turn(r) > 0):
        held = [i for i, b in enumerate(borders) if 2 * sum(inside(b, *p) for p in hole[:-1]) > len(hole) - 1]
        if held:
            polygons[min(held, key=lambda i: abs(turn(borders[i])))].append(hole)
        else:
            polygons.append([hole])
    return polygons


def geometries(shapes: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """Shapes as a column of polygons > rings > points."""
    rings = [r for s in shapes if s for p in s for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    of_ring = pa.ListArray.from_arrays(ends([len(r) for r in rings]), points)
    of_polygon = pa.ListArray.from_arrays(ends([len(p) for s in shapes if s for p in s]), of_ring)
    return pa.ListArray.from_arrays(ends([len(s or ()) for s in shapes]), of_polygon, mask=pa.array([s is None for s in shapes]))


class ShapeReader(TableReader):
    def batches(self, path: str, first: int, live: np.ndarray, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        stem = path[: -len(".dbf")]
        names = {p.lower(): p for p, _ in _files(path.rsplit("/", 1)[0], "")}
        shp, shx = (names.get(f"{stem}{e}".lower()) for e in (".shp", ".shx"))
        entries = _read(shx, HEADER + ENTRY * first, ENTRY * len(live)) if shx and shp else b""
        places = np.frombuffer(entries[: len(entries) // ENTRY * ENTRY], dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
        raw, start = b"", 0
        if len(places):
            start = int(places[:, 0].min())
            raw = _read(shp, start, int((places[:, 0] + places[:, 1]).max()) + ENTRY - start)
        shapes = []
        for k in np.flatnonzero(live).tolist():
            if k >= len(places):
                shapes.append(None)
                continue
            at, size = int(places[k, 0]) - start + ENTRY, int(places[k, 1])
            rings = rings_of(raw[at : at + size]) if at >= ENTRY and at + size <= len(raw) else None
            shapes.append(None if rings is None else nested(rings))
        columns["geom"] = geometries(shapes)
        yield pa.RecordBatch.from_arrays([columns[c.name] for c in self.schema], self.schema.names)


class ShapeSource(TableSource):
    """Shapefiles: the table's columns, and geom. Options: as for tables."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        return T.StructType([*super().schema(), T.StructField("geom", GEOMETRY)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapeReader(schema, {k.lower(): v for k, v in self.options.items()})


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class TableWriter(DataSourceWriter):
    """Each task writes whole files under names of its own; they get their last names when all tasks are done."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("tables are only added to: use mode append")
        self.schema, self.path, self.encoding, self.width = schema, options["path"], options.get("encoding", "latin-1"), int(options.get("width", 254))
        self.shapes = [c.name for c in schema if isinstance(c.dataType, T.ArrayType)]
        if len(self.shapes) > 1 or any(c != "geom" for c in self.shapes):
            raise ValueError("one geometry at most, named geom")
        self.fields, at = [], 1
        for c in schema:
            if c.name not in self.shapes:
                kind, size, decimals = self._field(c.dataType)
                if len(c.name.encode("latin-1")) > 10:
                    raise ValueError(f"names have ten bytes at most: {c.name}")
                self.fields.append(Field(c.name, kind, size, decimals, at))
                at += size
        self.size = at

    def _field(self, kind: T.DataType) -> tuple[str, int, int]:
        known = {"string": ("C", self.width, 0), "bigint": ("N", 18, 0), "int": ("N", 11, 0), "double": ("F", 24, 15), "boolean": ("L", 1, 0), "date": ("D", 8, 0)}
        if kind.simpleString() not in known:
            raise ValueError(f"tables have no {kind.simpleString()}")
        return known[kind.simpleString()]

    def _text(self, f: Field, v) -> bytes:
        if v is None:
            return b"?" if f.kind == "L" else b" " * f.size
        if f.kind == "L":
            return b"T" if v else b"F"
        text = v.strftime("%Y%m%d") if f.kind == "D" else repr(v) if f.kind == "F" else str(v)
        raw = text.encode(self.encoding)
        if len(raw) > f.size:
            raise ValueError(f"{f.name} has {f.size} bytes, not {len(raw)}")
        return raw.ljust(f.size) if f.kind == "C" else raw.rjust(f.size)

    def write(self, iterator) -> WriterCommitMessage:
        names, rows = [], []
        for row in iterator:
            rows.append(row)
            if len(rows) == FILE_RECORDS:
                names += self._write(rows)
                rows = []
        return Written(names + (self._write(rows) if rows else []))

    def _write(self, rows: list) -> list[str]:
        stem = f"part-{uuid.uuid4().hex}"
        head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 32 * len(self.fields) + 33, self.size)
        head += b"".join(struct.pack("<11sc4xBB14x", f.name.encode("latin-1"), f.kind.encode(), f.size, f.decimals) for f in self.fields) + b"\r"
        body = b"".join(b" " + b"".join(self._text(f, row[f.name]) for f in self.fields) for row in rows)
        files = {f"{stem}.dbf": head + body + b"\x1a"}
        if self.shapes:
            files |= dict(zip((f"{stem}.shp", f"{stem}.shx"), shape_files([row["geom"] for row in rows]), strict=True))
        system, inner = _at(self.path)
        system.create_dir(f"{inner}/_pending", recursive=True)
        for name, data in files.items():
            with system.open_output_stream(f"{inner}/_pending/{name}") as out:
                out.write(data)
        return list(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _at(self.path)
        system.create_dir(inner, recursive=True)
        if not any(m.names for m in messages if m is not None) and not _files(self.path, ".dbf"):
            messages = [Written(self._write([]))]  # the columns are known to readers, whatever rows there are
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{inner}/_pending/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """What is left is of tasks that failed or ran twice."""
        system, inner = _at(self.path)
        if system.get_file_info(f"{inner}/_pending").type == pafs.FileType.Directory:
            system.delete_dir(f"{inner}/_pending")


def shape_files(geoms: list) -> tuple[bytes, bytes]:
    """The shapes and their index: borders go clockwise, holes the other way, whatever way they went."""
    records, entries, at, boxes = [], [], HEADER, []
    for n, geom in enumerate(geoms, 1):
        content = struct.pack("<i", 0)
        if geom is not None and not any(p["x"] is None or p["y"] is None for polygon in geom for ring in polygon for p in ring):
            rings = [np.array([(p["x"], p["y"]) for p in ring], dtype="<f8") for polygon in geom for ring in polygon if ring]
            border = [k == 0 for polygon in geom for k, ring in enumerate(polygon) if ring]
            rings = [r[::-1] if (turn(r) > 0) == b else r for r, b in zip(rings, border, strict=True)]
            xy = np.concatenate(rings) if rings else np.zeros((0, 2))
            box = [*xy.min(0), *xy.max(0)] if len(xy) else [0.0] * 4
            boxes.append(box)
            starts = np.cumsum([0, *(len(r) for r in rings)])[:-1] if rings else []
            content = struct.pack("<i4dii", 5, *box, len(rings), len(xy)) + np.array(starts, dtype="<i4").tobytes() + np.ascontiguousarray(xy, dtype="<f8").tobytes()
        entries.append(struct.pack(">ii", at // 2, len(content) // 2))
        records.append(struct.pack(">ii", n, len(content) // 2) + content)
        at += ENTRY + len(content)
    b = np.array(boxes or [[0.0] * 4])
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii4d32x", 1000, 5, *b[:, :2].min(0), *b[:, 2:].max(0))
    return head(at) + b"".join(records), head(HEADER + ENTRY * len(entries)) + b"".join(entries)


def register(spark: SparkSession) -> None:
    """Makes the formats dbf and shapefile known to a session."""
    spark.dataSource.register(TableSource)
    spark.dataSource.register(ShapeSource)
