"""Queries: attribute tables and shapefiles, and areas that are merged, checked, repaired and laid over each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.operators import overlay as V
from townhall.operators import spatial as S
from townhall.operators.graph import folder_for
from townhall.plans.events import _seats
from townhall.plans.registry import query
from townhall.sources import mapfiles as M
from townhall.sources import markup as K
from townhall.sources.standins import view


@query("dbf_attributes", """select c_custkey number, c_name name, case c_custkey % 3 when 1 then 'SC' when 2 then 'ST' end reserved, 'North ' || c_nationkey district, round(c_acctbal::double, 2) balance, c_custkey % 2 = 0 active
  from customer where c_nationkey % 2 = 0""")  # fmt: skip
def dbf_attributes(spark, d):
    """Customers as attribute tables (.dbf), written by tasks and read back by runs of a hundred records; the rows of a state."""
    M.register(spark)
    path, k = folder_for(spark, "dbf"), F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 1, " (SC)").when(k % 3 == 2, " (ST) ").otherwise(""))
    rows = view(spark, d, "customer").select(
        F.when(F.col("c_nationkey") % 2 == 0, " Home State").otherwise("Other").alias("ST_NAME"), k.cast("long").alias("AC_NO"), name.alias("AC_NAME"), F.concat(F.lit("NORTH "), "c_nationkey").alias("DIST_NAME"),
        F.round(F.col("c_acctbal").cast("double"), 2).alias("BALANCE"), (k % 2 == 0).alias("ACTIVE"),
    )
    rows.write.format("dbf").option("width", 60).mode("append").save(path)
    back = spark.read.format("dbf").option("recordsPerPartition", 100).load(path)
    named = back.select(F.col("ST_NAME").alias("state"), F.col("AC_NO").alias("number"), F.col("AC_NAME").alias("name"), F.col("DIST_NAME").alias("district"))
    extra = back.select(F.col("AC_NO").alias("number"), F.col("BALANCE").alias("balance"), F.col("ACTIVE").alias("active"))
    return K.attribute_rows(named, "home state").join(extra, "number")


@query("shapefile_areas", """select c_custkey id, 'seat ' || c_custkey name, x x0, y y0, x + 2 x1, y + 2 y1, 1 + (c_custkey % 3 = 0)::int rings, 5 + 5 * (c_custkey % 3 = 0)::int points
  from (select c_custkey, floor((c_custkey * 37 % 5000) / 100.0 + 0.005)::double - 1 x, floor((c_custkey * 91 % 5000) / 100.0 + 0.005)::double - 1 y from customer)""")  # fmt: skip
def shapefile_areas(spark, d):
    """The squares around customers' points as shapefiles, a third of them with a hole, read back with their table's columns."""
    M.register(spark)
    path, hole = folder_for(spark, "shapes"), lambda x, y: F.struct((F.col("geom")[0][0][0]["x"] + x).alias("x"), (F.col("geom")[0][0][0]["y"] + y).alias("y"))
    holed = F.array(F.array(F.col("geom")[0][0], F.array(hole(0.5, 0.5), hole(1.5, 0.5), hole(1.5, 1.5), hole(0.5, 1.5), hole(0.5, 0.5))))
    seats = _seats(spark, d).withColumn("geom", F.when(F.col("area_id") % 3 == 0, holed).otherwise(F.col("geom")))
    seats.select(F.col("area_id").cast("long").alias("ID"), F.concat(F.lit("seat "), "area_id").alias("NAME"), "geom").write.format("shapefile").option("width", 20).mode("append").save(path)
    back = spark.read.format("shapefile").option("recordsPerPartition", 100).load(path)
    bounded = S.with_bounds(back.withColumn("rings", F.size(F.flatten("geom"))).withColumn("points", F.size(S.points_of(F.col("geom")))))
    return bounded.select(F.col("ID").alias("id"), F.col("NAME").alias("name"), "x0", "y0", "x1", "y1", "rings", "points")


@query("dissolved_areas", """with c as (select c_custkey % 40 i, c_custkey // 40 j, c_mktsegment segment from customer),
  near as (select c.segment, count(*) filter (n.segment is distinct from c.segment) sides from c cross join (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(x, y) left join c n on n.i = c.i + x and n.j = c.j + y group by c.segment)
  select segment, count(*)::double area, any_value(sides)::double perimeter from c join near using (segment) group by segment""")  # fmt: skip
def dissolved_areas(spark, d):
    """A unit square for each customer on one grid: those of a segment as one area, with its perimeter; borders between two of them are gone."""
    k = F.col("c_custkey")
    x, y = (k % 40).cast("double"), F.floor(k / 40).cast("double")
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))
    whole = V.dissolve(view(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.array(F.array(ring)).cast(S.GEOMETRY).alias("geom")), "segment", 1.0)
    rings = whole.select("segment", F.explode(F.flatten("geom")).alias("ring"))
    sides = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))
    return rings.groupBy("segment").agg((F.sum(V.twice_area(F.col("ring"))) / 2).alias("area"), F.sum(F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)).alias("perimeter"))


def _broken(spark, d):
    """An area for each customer: a bow-tie, one whose vertex lies on its own edge, one with a way to its hole, and a sound one."""
    k = F.col("c_custkey")
    ring = lambda *ps: F.array(*(F.struct((k * 10.0 + a).alias("x"), F.lit(float(b)).alias("y")) for a, b in (*ps, ps[0])))
    bow, touch, sound = ring((0, 0), (2, 2), (2, 0), (0, 2)), ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4)), ring((0, 0), (2, 0), (2, 2), (0, 2))
    keyhole = ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2))
    geom = F.when(k % 4 == 0, F.array(F.array(bow))).when(k % 4 == 1, F.array(F.array(touch))).when(k % 4 == 2, F.array(F.array(keyhole))).otherwise(F.array(F.array(sound)))
    return view(spark, d, "customer").select(k.alias("area_id"), geom.cast(S.GEOMETRY).alias("geom"))


@query("ring_problems", "select c_custkey area_id, case c_custkey % 4 when 0 then 'crossing' when 1 then 'touching' else 'shared vertex' end problem, case c_custkey % 4 when 2 then 2 else 1 end::bigint n from customer where c_custkey % 4 <> 3")
def ring_problems(spark, d):
    return V.ring_problems(_broken(spark, d), 5.0)


@query("repaired_areas", """select c_custkey area_id, case c_custkey % 4 when 0 then 2 when 1 then 2 else 1 end::int polygons, case c_custkey % 4 when 2 then 2 when 3 then 1 else 2 end::int rings,
  case c_custkey % 4 when 0 then 2 when 1 then 8 when 2 then 32 else 4 end::double area from customer""")  # fmt: skip
def repaired_areas(spark, d):
    """The broken areas as polygons that don't cross, by the even-odd rule."""
    area = F.aggregate(F.flatten("geom"), F.lit(0.0), lambda s, r: s + V.twice_area(r)) / 2
    return V.repaired(_broken(spark, d), 5.0).select("area_id", F.size("geom").alias("polygons"), F.size(F.flatten("geom")).alias("rings"), F.round(area, 9).alias("area"))


@query("overlap_slanted", """with d as (select c_custkey area_id, floor((c_custkey * 37 % 5000) / 100.0 + 0.005) + 0.25 * (c_custkey % 4) x from customer),
  t as (select area_id, r_regionkey parent_id, greatest(-1, least(1, 10 * r_regionkey - x)) lo, greatest(-1, least(1, 10 * r_regionkey + 10 - x)) hi from d, region),
  s as (select area_id, parent_id, (case when hi <= 0 then (1 + hi) * (1 + hi) else 2 - (1 - hi) * (1 - hi) end - case when lo <= 0 then (1 + lo) * (1 + lo) else 2 - (1 - lo) * (1 - lo) end) / 2 share from t)
  select area_id, parent_id::int parent_id, round(share, 4)::double share from (select *, row_number() over (partition by area_id order by share desc, parent_id) rn from s where share > 0) where rn = 1""")  # fmt: skip
def overlap_slanted(spark, d):
    """A square on its corner for each customer, and the upright strip that has most of its area: no edge lies on a grid."""
    k = F.col("c_custkey")
    x, y = F.floor((k * 37 % 5000) / 100.0 + 0.005) + 0.25 * (k % 4), ((k * 91 % 5000) / 100.0 + 0.005)
    ring = lambda x, y, *ps: F.array(F.array(F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in (*ps, ps[0]))))).cast(S.GEOMETRY)
    seats = view(spark, d, "customer").select(k.alias("area_id"), ring(x, y, (0.0, -1.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)).alias("geom"))
    left = F.col("r_regionkey") * 10.0
    strips = view(spark, d, "region").select(F.col("r_regionkey").alias("area_id"), ring(left, F.lit(0.0), (0.0, -5.0), (10.0, -5.0), (10.0, 60.0), (0.0, 60.0)).alias("geom"))
    return V.overlap_assign(seats, strips, 2.0)
