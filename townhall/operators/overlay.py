"""Areas as edges: union without inner borders, problems of rings and their repair, and overlaps by area.

Edges meet on the grid cells that they pass, are split where they cross or touch, and cancel where two of opposite
direction are the same. What is left is stitched: at a vertex, edges that come are paired with edges that go so that
no two pairs cross, and rings are told apart by pointer jumping over the edges, a table a round; areas of few edges in one row.
No step holds more than one ring, the edges at one vertex, or a batch of rows of these."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.operators.graph import forget, written
from townhall.operators.spatial import GEOMETRY, cells, contains, point_in_polygon, with_bounds

#: How far from a line, in parts of the lengths, a point counts as on it.
EPS = 1e-12
#: Edges of a key that are stitched in one row; a key with more of them is stitched in rounds.
FEW = 256


def twice_area(ring: Column) -> Column:
    """Twice the area that a closed ring goes around, negative if it goes clockwise; measured from its first point."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def edges_of(areas: DataFrame, key: str, directed: bool = True) -> DataFrame:
    """key, edge, ax, ay, bx, by: the edges of areas (key, geom), each with a number.

    directed: the area is on the left of all its edges, whatever way its rings went: the first ring of a polygon is its
    border, others are holes. Rings that aren't closed are; edges without length are left out."""
    polygons = areas.select(key, F.explode("geom").alias("polygon"))
    rings = polygons.select(key, F.posexplode("polygon").alias("place", "ring")).filter("size(ring) > 1")
    closed = F.when(F.col("ring")[0] == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.col("ring")[0])))
    rings = rings.withColumn("ring", closed)
    if directed:
        wrong = (twice_area(F.col("ring")) > 0) != (F.col("place") == 0)
        rings = rings.withColumn("ring", F.when(wrong, F.reverse("ring")).otherwise(F.col("ring")))
    ends = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    each = rings.select(key, F.explode(ends).alias("e")).select(key, "e.*").filter("ax <> bx or ay <> by")
    return written(each.withColumn("edge", F.monotonically_increasing_id()), "edges")


def cells_passed(size: float, slack: float = 1e-6) -> Column:
    """The cells (cx, cy) that an edge passes, or comes as near as slack (in cells): column by column, the part of the edge that lies in it."""
    cell = lambda v: F.floor(v / size)
    lo, hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    slope = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))

    def column(cx: Column) -> Column:
        x0, x1 = F.greatest(lo, cx * size), F.least(hi, (cx + 1) * size)
        at = lambda x: F.col("ay") + slope * (x - F.col("ax"))
        low = F.when(slope.isNull(), F.least("ay", "by")).otherwise(F.least(at(x0), at(x1)))
        high = F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(F.greatest(at(x0), at(x1)))
        return F.transform(F.sequence(cell(low - size * slack), cell(high + size * slack)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(lo - size * slack), cell(hi + size * slack)), column))


def _turn(p: str, q: str, r: str) -> Column:
    """Which side of p > q the point r is on: 0 if it is on the line, as far as EPS tells."""
    px, py, qx, qy, rx, ry = (F.col(v) for v in (p + "x", p + "y", q + "x", q + "y", r + "x", r + "y"))
    t = (qx - px) * (ry - py) - (qy - py) * (rx - px)
    scale = (F.abs(qx - px) + F.abs(qy - py)) * (F.abs(rx - px) + F.abs(ry - py))
    return F.when(F.abs(t) <= EPS * scale, F.lit(0.0)).otherwise(t)


def meetings(left: DataFrame, right: DataFrame, size: float, on: list[str] | None = None) -> DataFrame:
    """l_edge, r_edge, kind, x, y: where edges of two tables meet (with equal columns `on`): crossing, or a vertex of one
    inside the other (touching), which overlapping edges have, too, or at a vertex of both (vertex).

    What pairs of a cell have in common is found where they meet, so that no pair is shuffled. One side alone goes to cells nearby."""
    on = on or []
    l = left.select(*on, F.col("edge").alias("l_edge"), *(F.col(f"{v}{c}").alias(f"l{v}{c}") for v in "ab" for c in "xy"), F.explode(cells_passed(size, 0.0)).alias("cell"))
    r = right.select(*on, F.col("edge").alias("r_edge"), *(F.col(f"{v}{c}").alias(f"r{v}{c}") for v in "ab" for c in "xy"), F.explode(cells_passed(size)).alias("cell"))
    near = F.lit(True)
    for c in "xy":
        reach = lambda side, end: end(f"{side}a{c}", f"{side}b{c}")
        near = near & (reach("l", F.greatest) >= reach("r", F.least) - size * 1e-6) & (reach("r", F.greatest) >= reach("l", F.least) - size * 1e-6)
    pairs = l.join(r, [*on, "cell"]).filter((F.col("l_edge") != F.col("r_edge")) & near)
    pairs = pairs.withColumns({"d1": _turn("la", "lb", "ra"), "d2": _turn("la", "lb", "rb"), "d3": _turn("ra", "rb", "la"), "d4": _turn("ra", "rb", "lb")})
    t = F.col("d3") / (F.col("d3") - F.col("d4"))
    point = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    cross = F.when((F.col("d1") * F.col("d2") < 0) & (F.col("d3") * F.col("d4") < 0), point("crossing", F.col("lax") + t * (F.col("lbx") - F.col("lax")), F.col("lay") + t * (F.col("lby") - F.col("lay"))))
    same = lambda p, q: (F.col(p + "x") == F.col(q + "x")) & (F.col(p + "y") == F.col(q + "y"))
    between = lambda p, q, v: (F.col(v + "x").between(F.least(p + "x", q + "x"), F.greatest(p + "x", q + "x"))) & (F.col(v + "y").between(F.least(p + "y", q + "y"), F.greatest(p + "y", q + "y")))
    found = [cross]
    for d, (p, q), v in (("d1", ("la", "lb"), "ra"), ("d2", ("la", "lb"), "rb"), ("d3", ("ra", "rb"), "la"), ("d4", ("ra", "rb"), "lb")):
        corner = same(v, p) | same(v, q)
        found.append(F.when((F.col(d) == 0) & between(p, q, v) & ~corner, point("touching", F.col(v + "x"), F.col(v + "y"))))
        if v[0] == "r":
            found.append(F.when(corner, point("vertex", F.col(v + "x"), F.col(v + "y"))))
    return pairs.select("l_edge", "r_edge", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("m")).select("l_edge", "r_edge", "m.*").distinct()


def split(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The edges' pieces between points (edge, x, y) on them, in the direction of their edge."""
    by = [c for c in points.columns if c not in ("x", "y")]  # the edge, or each edge once for each of another column's values
    keys = [c for c in edges.columns if c not in ("ax", "ay", "bx", "by")]
    along = (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))
    at = points.distinct().join(edges.select(*by, "ax", "ay", "bx", "by"), by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(along.alias("t"), F.col("x").alias("x"), F.col("y").alias("y")))).alias("on"))
    inner = F.coalesce(F.transform("on", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    whole = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), inner, F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    parts = F.zip_with(F.slice(whole, 1, F.size(whole) - 1), F.slice(whole, 2, F.size(whole) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return edges.join(at, by, "left").select(*keys, F.explode(parts).alias("e")).select(*keys, "e.*").filter("ax <> bx or ay <> by")


def split_among(edges: DataFrame, key: str, size: float) -> DataFrame:
    """The edges' pieces between all places where edges of one key meet."""
    met = meetings(edges, edges, size, [key]).filter("kind <> 'vertex' and l_edge < r_edge")
    points = met.select(F.explode(F.array("l_edge", "r_edge")).alias("edge"), "x", "y")
    # a touching vertex is one end of its own edge; there it cuts nothing
    return written(split(edges, points), "pieces")


def cancelled(pieces: DataFrame, key: str, once: bool) -> DataFrame:
    """key, ax, ay, bx, by of the pieces that are left when those of opposite direction have cancelled; of equal ones one,
    if `once`, else as many as there are more of."""
    flips = F.struct("bx", "by") < F.struct("ax", "ay")
    low = [F.when(flips, F.col(f"b{c}")).otherwise(F.col(f"a{c}")).alias(f"l{c}") for c in "xy"]
    high = [F.when(flips, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"h{c}") for c in "xy"]
    net = pieces.select(key, *low, *high, F.when(flips, -1).otherwise(1).alias("sign")).groupBy(key, "lx", "ly", "hx", "hy").agg(F.sum("sign").alias("net")).filter("net <> 0")
    back = F.col("net") < 0
    copies = net.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(1) if once else F.abs("net").cast("int"))))
    end = lambda a, z: [F.when(back, F.col(f"{z}{c}")).otherwise(F.col(f"{a}{c}")) for c in "xy"]
    (ax, ay), (bx, by) = end("l", "h"), end("h", "l")
    return copies.select(key, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), F.abs("net").alias("times"))


def paired(around: list[tuple[float, bool, int]]) -> list[tuple[int, int]]:
    """(edge that comes, edge that goes) for the edges (angle, goes, edge) at a vertex, so that no two pairs cross.

    Counter-clockwise, what lies between an edge that goes and the next that comes is inside; so one that comes is paired
    with the last one before it that goes and has no partner."""
    order = sorted(around, key=lambda e: (e[0], not e[1], e[2]))
    height, low, start = 0, 0, 0
    for k, (_, goes, _) in enumerate(order):
        height += 1 if goes else -1
        if height < low:
            low, start = height, k + 1
    open_, out = [], []
    for _, goes, edge in order[start:] + order[:start]:
        if goes:
            open_.append(edge)
        elif open_:
            out.append((edge, open_.pop()))
    return out


def followed(nexts: list[int | None]) -> list[list[int]]:
    """The closed rings of edges 0, 1, ..., each from its least edge, by the edge that comes next."""
    seen, out = [False] * len(nexts), []
    for first in range(len(nexts)):
        ring, at = [], first
        while at is not None and not seen[at]:
            seen[at] = True
            ring.append(at)
            at = nexts[at]
        if ring and at == first:
            out.append(ring)
    return out


def linked(edges: list[tuple]) -> list[int | None]:
    """Which of the directed edges (ax, ay, bx, by) comes after each."""
    around = {}
    for k, (ax, ay, bx, by) in enumerate(edges):
        around.setdefault((ax, ay), []).append((math.atan2(by - ay, bx - ax), True, k))
        around.setdefault((bx, by), []).append((math.atan2(ay - by, ax - bx), False, k))
    nexts = [None] * len(edges)
    for ends in around.values():
        for comes, goes in paired(ends):
            nexts[comes] = goes
    return nexts


def _pair_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [p for ends in pdf["ends"] for p in paired([(e["angle"], e["goes"], e["edge"]) for e in ends])]
        yield pd.DataFrame(rows, columns=["edge", "next"], dtype="int64")


def _rings_of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a column and the edges (n, next, times, ax, ay, bx, by) of one ring, or without next of several: their
    rings, with the middle of the first of the edges that are there least often."""
    for batch in batches:
        key, lists = batch.column(0), batch.column(1)
        fields = {f.name: v.to_pylist() for f, v in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
        every = list(zip(*(fields[c] for c in ("ax", "ay", "bx", "by")), strict=True))
        of, points, xs, ys, at = [], [], [], [], 0
        for i, n in enumerate(lists.value_lengths().to_pylist()):
            edges, times = every[at : at + n], fields["times"][at : at + n]
            if "next" in fields:
                place = {e: k for k, e in enumerate(fields["n"][at : at + n])}
                nexts = [place[e] for e in fields["next"][at : at + n]]
            else:
                nexts = linked(edges)
            at += n
            for ring in followed(nexts):
                least = min(ring, key=lambda k: (times[k], k))
                of.append(i)
                points.append([{"x": edges[k][0], "y": edges[k][1]} for k in [*ring, ring[0]]])
                xs.append((edges[least][0] + edges[least][2]) / 2)
                ys.append((edges[least][1] + edges[least][3]) / 2)
        corner = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(of, pa.int64())), pa.array(points, corner), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], [batch.schema.names[0], "points", "mx", "my"])


def simple_loops(ring: list) -> list[list]:
    """A closed ring that comes to points more than once, as closed loops that don't."""
    path, at, out = [], {}, []
    for point in ring:
        if point in at:
            k = at[point]
            out.append([*path[k:], point])
            for p in path[k + 1 :]:
                del at[p]
            del path[k + 1 :]
        else:
            at[point] = len(path)
            path.append(point)
    return out


def _loops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, [{"x": x, "y": y} for x, y in loop]) for k, ring in zip(pdf.iloc[:, 0], pdf["points"], strict=True) for loop in simple_loops([(p["x"], p["y"]) for p in ring])]
        yield pd.DataFrame(rows, columns=list(pdf.columns))


def stitched(edges: DataFrame, key: str) -> DataFrame:
    """key, ring, points, twice, mx, my of the closed rings of directed edges: twice their area, and the middle of an edge.

    The edges of a key that has few (FEW) are stitched together in one row; those of others vertex by vertex, in rounds."""
    edges = written(edges.withColumn("edge", F.monotonically_increasing_id()), "directed")
    same = F.xxhash64(key)  # keys may be null; of keys with one hash both have many
    many = written(edges.groupBy(same.alias("hash")).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("hash"), "many")
    kind = edges.select(F.lit(None).cast(edges.schema[key].dataType).alias(key), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")).schema
    ends = ["ax", "ay", "bx", "by"]
    few = edges.withColumn("hash", same).join(many, "hash", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("edge").alias("n"), "times", *ends))).alias("edges"))
    rings = few.select(key, "edges").mapInArrow(_rings_of_edges, kind)
    if not many.isEmpty():
        rings = rings.unionByName(_stitched_in_rounds(edges.withColumn("hash", same).join(many, "hash", "left_semi").drop("hash"), key).mapInArrow(_rings_of_edges, kind))
    found = written(rings, "found")
    again = F.size(F.array_distinct("points")) < F.size("points") - 1
    touching = found.filter(again).select(key, "points").mapInPandas(_loops, found.select(key, "points").schema)
    middle = lambda c: ((F.col("points")[0][c] + F.col("points")[1][c]) / 2).alias(f"m{c}")
    out = found.filter(~again).unionByName(touching.select(key, "points", middle("x"), middle("y"))).withColumn("twice", twice_area(F.col("points")))
    out = written(out.filter("size(points) > 3 and abs(twice) > 1e-300").withColumn("ring", F.monotonically_increasing_id()), "stitched")
    forget(found, many, edges)
    return out.select(key, "ring", "points", "mx", "my", "twice")


def _stitched_in_rounds(edges: DataFrame, key: str) -> DataFrame:
    """key, edges (n, next, times, ax, ay, bx, by) of each ring."""
    angle = lambda x0, y0, x1, y1: F.atan2(F.col(y1) - F.col(y0), F.col(x1) - F.col(x0)).alias("angle")
    goes = edges.select(key, F.col("ax").alias("x"), F.col("ay").alias("y"), F.struct(angle("ax", "ay", "bx", "by"), F.lit(True).alias("goes"), "edge").alias("end"))
    comes = edges.select(key, F.col("bx").alias("x"), F.col("by").alias("y"), F.struct(angle("bx", "by", "ax", "ay"), F.lit(False).alias("goes"), "edge").alias("end"))
    at = written(goes.unionByName(comes).groupBy(key, "x", "y").agg(F.collect_list("end").alias("ends")), "vertices")
    edge_that = lambda go: F.filter("ends", lambda e: e["goes"] == go)[0]["edge"]
    plain = at.filter("size(ends) = 2").select(edge_that(False).alias("edge"), edge_that(True).alias("next")).filter("edge is not null and next is not null")
    links = written(plain.unionByName(at.filter("size(ends) > 2").select("ends").mapInPandas(_pair_all, "edge long, next long")), "links")
    forget(at)

    # which ring: the least edge within twice as many steps each round
    state = written(links.select("edge", F.col("next").alias("jump"), F.least("edge", "next").alias("ring")), "rings")
    while True:
        there = state.select(F.col("edge").alias("jump"), F.col("jump").alias("further"), F.col("ring").alias("r"))
        after = written(state.join(there, "jump").select("edge", F.col("further").alias("jump"), F.least("ring", "r").alias("ring"), (F.col("r") < F.col("ring")).alias("changed")), "rings")
        changed = not after.filter("changed").isEmpty()
        forget(state)
        state = after.drop("changed")
        state.folder = after.folder
        if not changed:
            break
    # a ring is one row in the end, so its edges come to one row to be put in order
    whole = state.select("edge", "ring").join(links, "edge").join(edges.select(key, "edge", "times", "ax", "ay", "bx", "by"), "edge")
    return whole.groupBy(key, "ring").agg(F.array_sort(F.collect_list(F.struct(F.col("edge").alias("n"), "next", "times", "ax", "ay", "bx", "by"))).alias("edges")).select(key, "edges")


def holders(rings: DataFrame, key: str, size: float) -> DataFrame:
    """ring, holder, h_twice: the rings of the same key that the middle of a ring's edge lies in; they meet on cells of their key."""
    same = F.xxhash64(key).alias("same")
    areas = with_bounds(rings.select(F.col(key).alias("h_key"), same, F.col("ring").alias("holder"), F.abs("twice").alias("h_twice"), F.array(F.array("points")).cast(GEOMETRY).alias("geom")))
    held = areas.select("h_key", "same", "holder", "h_twice", "geom", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("cell"))
    at = rings.select(F.col(key).alias("o_key"), same, "ring", "mx", "my", F.struct(F.floor(F.col("mx") / size).alias("cx"), F.floor(F.col("my") / size).alias("cy")).alias("cell"))
    met = at.join(held, ["same", "cell"]).filter((F.col("ring") != F.col("holder")) & F.col("o_key").eqNullSafe(F.col("h_key")))
    return met.filter(contains(F.col("geom"), F.col("mx"), F.col("my"))).select("ring", "holder", "h_twice")


def assembled(rings: DataFrame, inside: DataFrame, key: str) -> DataFrame:
    """key, geom: rings with is_hole as polygons, each hole in the least border around it (inside: ring, holder, h_twice)."""
    borders = rings.filter("not is_hole").select(key, F.col("ring").alias("border"), "points")
    least = inside.join(borders.select(F.col("border").alias("holder")), "holder", "left_semi").groupBy("ring").agg(F.min(F.struct("h_twice", "holder")).alias("h"))
    way = lambda hole: F.when((F.col("twice") > 0) == F.lit(hole), F.reverse("points")).otherwise(F.col("points"))
    holes = rings.filter("is_hole").join(least, "ring").select(F.col("h.holder").alias("border"), F.struct("ring", way(True).alias("points")).alias("hole")).groupBy("border").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    outer = rings.filter("not is_hole").select(key, F.col("ring").alias("border"), way(False).alias("points")).join(holes, "border", "left")
    polygon = F.concat(F.array("points"), F.coalesce(F.transform("holes", lambda h: h["points"]), F.array().cast("array<array<struct<x:double,y:double>>>")))
    placed = outer.select(key, F.struct("border", polygon.alias("rings")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return placed.select(key, F.transform("ps", lambda p: p["rings"]).cast(GEOMETRY).alias("geom"))


def dissolve(areas: DataFrame, parent: str, size: float) -> DataFrame:
    """parent, geom: the union of the areas (geom) of each parent, without the borders that two of them share.

    Borders are shared where they lie on each other, also in part: edges are split at all vertices on them first. Members are
    taken not to overlap; where they do, their borders inside the overlap stay. Borders go counter-clockwise, holes clockwise; a
    hole that the members leave between them is one. Members without rings add nothing; a parent of only such isn't there.
    size: of the grid cells on which edges meet, best about the length of an edge."""
    pieces = split_among(edges_of(areas.select(parent, "geom"), parent), parent, size)
    rings = stitched(cancelled(pieces, parent, once=True), parent)
    marked = rings.withColumn("is_hole", F.col("twice") < 0)
    return assembled(marked, holders(marked, parent, size), parent)


def ring_problems(areas: DataFrame, size: float) -> DataFrame:
    """area_id, problem, n: how often edges of an area cross (crossing), a vertex lies inside another edge (touching), or a
    vertex is one of more than two edges (shared vertex). Areas without a problem aren't there."""
    edges = edges_of(areas.select("area_id", "geom"), "area_id", directed=False)
    met = meetings(edges, edges, size, ["area_id"]).filter("l_edge < r_edge and kind <> 'vertex'")
    places = met.join(edges.select(F.col("edge").alias("l_edge"), "area_id"), "l_edge").select("area_id", F.col("kind").alias("problem"), "x", "y").distinct()
    ends = edges.select("area_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("v")).groupBy("area_id", "v").agg(F.count("*").alias("n"))
    shared = ends.filter("n > 2").select("area_id", F.lit("shared vertex").alias("problem"), "v.x", "v.y")
    return places.unionByName(shared).groupBy("area_id", "problem").agg(F.count("*").alias("n"))


def repaired(areas: DataFrame, size: float) -> DataFrame:
    """area_id, geom: areas again, of rings that don't cross: split where edges meet, and taken apart into loops.

    The rule is even-odd: a loop that an even number of others holds is a border, one that an odd number holds is a
    hole in the least around it. So a bow-tie becomes two polygons, a ring that touches itself a border with a hole or two
    polygons, an edge there and back goes, and a sound area stays what it is. Holes of the input cut wherever they lie."""
    edges = edges_of(areas.select("area_id", "geom"), "area_id")
    rings = stitched(cancelled(split_among(edges, "area_id", size), "area_id", once=False), "area_id")
    once = rings.withColumn("rn", F.row_number().over(Window.partitionBy("area_id", F.xxhash64(F.array_sort(F.array_distinct("points")))).orderBy("ring"))).filter("rn = 1").drop("rn")
    once = written(once, "loops")
    inside = written(holders(once, "area_id", size), "inside")
    depth = inside.groupBy("ring").agg(F.count("*").alias("depth"))
    marked = once.join(depth, "ring", "left").withColumn("is_hole", F.coalesce("depth", F.lit(0)) % 2 == 1)
    return assembled(marked, inside, "area_id")


def on_edges(pieces: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """The pieces (piece, ax, ay, bx, by) whose middle lies on an edge, with the edge's other columns, and whether both have one direction (same)."""
    names = [c for c in edges.columns if c not in ("ax", "ay", "bx", "by")]
    line = edges.select(*names, *(F.col(f"{v}{c}").alias(f"e{v}{c}") for v in "ab" for c in "xy"), F.explode(cells_passed(size)).alias("cell"))
    middle = pieces.select("piece", "ax", "ay", "bx", "by", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))
    met = middle.withColumn("cell", F.struct(F.floor(F.col("mx") / size).alias("cx"), F.floor(F.col("my") / size).alias("cy"))).join(line, "cell")
    ways = (F.col("bx") - F.col("ax")) * (F.col("ebx") - F.col("eax")) + (F.col("by") - F.col("ay")) * (F.col("eby") - F.col("eay"))
    along = F.col("mx").between(F.least("eax", "ebx"), F.greatest("eax", "ebx")) | F.col("my").between(F.least("eay", "eby"), F.greatest("eay", "eby"))
    reach = (F.col("mx") - F.col("eax")) * (F.col("mx") - F.col("ebx")) + (F.col("my") - F.col("eay")) * (F.col("my") - F.col("eby")) < 0
    return met.filter((_turn("ea", "eb", "m") == 0) & along & reach).select("piece", *names, (ways > 0).alias("same")).distinct()


def on_border(geom: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge of the geometry, as far as EPS tells."""
    def on(a: Column, b: Column) -> Column:
        t = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        scale = (F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"])) * (F.abs(x - a["x"]) + F.abs(y - a["y"]))
        return (F.abs(t) <= EPS * scale) & ((x - a["x"]) * (x - b["x"]) + (y - a["y"]) * (y - b["y"]) < 0)

    pairs = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.lit(0), F.size(r) - 1)), F.slice(r, 2, F.greatest(F.lit(0), F.size(r) - 1)), on)
    return F.exists(F.flatten(geom), lambda r: F.exists(pairs(r), lambda v: F.coalesce(v, F.lit(False))))


def common_areas(small: DataFrame, large: DataFrame, size: float) -> DataFrame:
    """area_id, parent_id, common, own: the area that each small and large one (area_id, geom) have in common, and the small one's own.

    By the border of what is common: pieces of the one's edges inside the other, and pieces that both have in one direction, each
    once. A large one's edge is split for each small one that it meets by that one's edges alone, so however many lie on it, it has
    as many pieces as pairs meet; a piece is inside, outside, or on the other's border."""
    s, l = edges_of(small.select("area_id", "geom"), "area_id"), edges_of(large.select(F.col("area_id").alias("parent_id"), "geom"), "parent_id")
    l = written(l.withColumn("edge", -1 - F.col("edge")), "large-edges")  # numbers of its own
    met = written(meetings(s, l, size).filter("kind <> 'vertex'").join(s.select(F.col("edge").alias("l_edge"), "area_id"), "l_edge"), "meetings")
    ends, middle = ["ax", "ay", "bx", "by"], [((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")]
    s_cut = written(split(s, met.select(F.col("l_edge").alias("edge"), "x", "y")).withColumn("piece", F.monotonically_increasing_id()), "cut")
    # about the small one's corner, so that large coordinates cost no digits
    corner = small.select("area_id", F.array_min(F.transform(F.flatten(F.flatten("geom")), lambda p: p["x"])).alias("ox"), F.array_min(F.transform(F.flatten(F.flatten("geom")), lambda p: p["y"])).alias("oy"))
    s_on = written(on_edges(s_cut, l.select("parent_id", *ends), size).select("piece", "parent_id", "same"), "on-border")

    columns = ["area_id", "parent_id", *ends]
    # the small ones' pieces; a point's id is all that is needed of its piece
    hit = point_in_polygon(s_cut.select(F.struct("piece", "area_id", *ends).alias("point_id"), *middle), large.select("area_id", "geom"), size)
    s_in = hit.select("point_id.*", F.col("area_id").alias("parent_id")).join(s_on.select("piece", "parent_id"), ["piece", "parent_id"], "left_anti")
    # the large ones' pieces: of edges that meet a small one, and whole edges that don't
    crossed = met.select(F.col("r_edge").alias("edge"), "area_id", "x", "y")
    pairs = crossed.select("edge", "area_id").distinct()
    cut = split(pairs.join(l, "edge"), crossed)
    whole = point_in_polygon(l.select(F.struct("edge", "parent_id", *ends).alias("point_id"), *middle), small.select("area_id", "geom"), size)
    whole = whole.select("point_id.*", "area_id").join(pairs, ["edge", "area_id"], "left_anti")
    held = cut.select(*columns).unionByName(whole.select(*columns)).join(small.select("area_id", "geom"), "area_id").select(*columns, "geom", *middle)
    l_in = held.filter(contains(F.col("geom"), F.col("x"), F.col("y")) & ~on_border(F.col("geom"), F.col("x"), F.col("y")))

    both = s_on.filter("same").select("piece", "parent_id").join(s_cut, "piece")
    cross = lambda: (F.col("ax") - F.col("ox")) * (F.col("by") - F.col("oy")) - (F.col("bx") - F.col("ox")) * (F.col("ay") - F.col("oy"))
    every = s_in.select(*columns).unionByName(l_in.select(*columns)).unionByName(both.select(*columns)).join(corner, "area_id")
    common = every.groupBy("area_id", "parent_id").agg((F.sum(cross()) / 2).alias("common"))
    own = s.join(corner, "area_id").groupBy("area_id").agg((F.sum(cross()) / 2).alias("own"))
    return common.filter("common > 0").join(own, "area_id").select("area_id", "parent_id", "common", "own")


def overlap_assign(small: DataFrame, large: DataFrame, size: float) -> DataFrame:
    """area_id, parent_id, share of the large area that holds most of each small one, by area; the lesser id of equals."""
    share = common_areas(small, large, size).select("area_id", "parent_id", F.round(F.col("common") / F.col("own"), 9).alias("share"))
    best = Window.partitionBy("area_id").orderBy(F.desc("share"), "parent_id")
    return share.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("area_id", "parent_id", F.round("share", 4).alias("share"))
