"""Points and polygons without a geometry library: grid cells as join keys, then even-odd counting.

A geometry is polygons > rings > points (x, y); the first ring of a polygon is its border, others are holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def points_of(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def with_bounds(areas: DataFrame, geom: str = "geom") -> DataFrame:
    """areas with x0, y0, x1, y1; null for a geometry without points."""
    xs, ys = F.transform(points_of(F.col(geom)), lambda p: p["x"]), F.transform(points_of(F.col(geom)), lambda p: p["y"])
    return areas.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def load_features(features: DataFrame, aliases: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """area_id, x0, y0, x1, y1, problem of features (name, geom): names by their alias (alias, area_id), with their bounds.

    A problem is a name that no alias knows, a feature that isn't whole inside the region (x0, y0, x1, y1) or has no
    points, or one of several features of an area."""
    known = with_bounds(features.join(aliases.select(F.col("alias").alias("name"), "area_id"), "name", "left"))
    n = known.groupBy("area_id").agg(F.count("*").alias("n"))
    inside = (F.col("x0") >= region[0]) & (F.col("y0") >= region[1]) & (F.col("x1") <= region[2]) & (F.col("y1") <= region[3])
    problem = F.when(F.col("area_id").isNull(), "unknown name").when(~F.coalesce(inside, F.lit(False)), "outside").when(F.col("n") > 1, "repeated")
    return known.join(n, "area_id", "left").select("name", "area_id", "x0", "y0", "x1", "y1", problem.alias("problem"))


def geometry_coverage(places: DataFrame, areas: DataFrame) -> DataFrame:
    """level, total, with_geometry, x0, y0, x1, y1: how many places (code, level) have a geometry (code, geom), and the bounds of all of a level."""
    bounded = with_bounds(areas).filter("x0 is not null").groupBy("code").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    joined = places.join(bounded, "code", "left")
    return joined.groupBy("level").agg(F.count("*").alias("total"), F.count("x0").alias("with_geometry"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def contains(geom: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the right crosses an odd number of edges; holes count as edges, too.

    An edge has its lower end and not its upper one, so a point on a common border is in one area only."""
    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        crossed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
        return F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False))))

    rings = F.flatten(geom)
    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def cells(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, size: float) -> Column:
    """The grid cells (cx, cy) that a box touches."""
    along = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(along(lo_x, hi_x), lambda cx: F.transform(along(lo_y, hi_y), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def point_in_polygon(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """point_id, area_id for each point (x, y) in an area (geom); points and areas meet on grid cells of a size."""
    gridded = with_bounds(areas).withColumn("cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    at = points.withColumn("cell", F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")))
    met = at.join(gridded.select("area_id", "geom", "cell"), "cell")
    return met.filter(contains(F.col("geom"), F.col("x"), F.col("y"))).select("point_id", "area_id")


def merge_polygons(areas: DataFrame, parent: str) -> DataFrame:
    """The polygons of all areas of a parent as one geometry; inner borders stay, what is inside doesn't change."""
    return areas.groupBy(parent).agg(F.flatten(F.collect_list("geom")).alias("geom"))


def overlap_decision(share: Column, assigned: Column, listed: Column, same: Column) -> Column:
    """fill a withheld one from 0.5; override a listed one from 0.97; report another one over 0.55; else keep."""
    return F.when(assigned.isNull(), F.when(share >= 0.5, "fill").otherwise("withheld")).when(same, "agrees").when(listed & (share >= 0.97), "override").when(share > 0.55, "mismatch").otherwise("keep")


def geometry_audit(areas: DataFrame) -> DataFrame:
    """area_id, problem for each ring that isn't closed, has under four points, or no area."""
    ring = areas.select("area_id", F.explode(F.flatten("geom")).alias("ring"))
    twice = F.aggregate(F.zip_with(F.slice("ring", 1, F.greatest(F.lit(0), F.size("ring") - 1)), F.slice("ring", 2, F.greatest(F.lit(0), F.size("ring") - 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    problem = F.when(F.size("ring") < 4, "under four points").when(F.element_at("ring", 1) != F.element_at("ring", -1), "not closed").when(F.abs(twice) < 1e-12, "no area")
    return ring.select("area_id", problem.alias("problem")).filter("problem is not null")
