"""Queries: event grouping, evidence, and places on a map."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.operators import events as E
from townhall.operators import overlay as V
from townhall.operators import spatial as S
from townhall.operators.graph import written
from townhall.plans.registry import query
from townhall.sources.standins import view, with_views

#: An item's strings: the three longest different words of its text, seven letters at least.
WORDS = """select item_id, unnest(list_transform(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(lower(headline), '[a-z]+')), lambda w: length(w) >= 7), lambda w: {'n': -length(w), 'w': w}))[1:3], lambda x: x.w)) w from items"""
ENTITIES = f"""entities as (select item_id, 'district' kind, district as value from items where item_id % 3 <> 1 union all
  select item_id, 'string', w from ({WORDS}) union all
  select item_id, 'person', 'p' || (item_id // 50)::varchar from items where item_id % 10 = 3)"""
PAIRS = """tokens as (select distinct item_id, kind, value from entities where kind <> 'district' and not (kind = 'string' and value in ('tamil nadu', 'india', 'tn', 'tamilnadu'))),
pairs as (select item_a, item_b, n_persons, n_strings from (
  select a.item_id item_a, b.item_id item_b, count(*) filter (a.kind = 'person') n_persons, count(*) filter (a.kind = 'string') n_strings
  from tokens a join tokens b on a.kind = b.kind and a.value = b.value and a.item_id < b.item_id
  join items x on x.item_id = a.item_id join items y on y.item_id = b.item_id where abs(epoch(x.published_at) - epoch(y.published_at)) < 259200 group by 1, 2)
  where n_persons >= 1 or n_strings >= 2 or (n_strings >= 1 and item_a % 3 <> 1 and item_b % 3 <> 1 and item_a % 25 = item_b % 25))"""


def _entities(spark, d):
    items = view(spark, d, "items")
    district = items.filter("item_id % 3 <> 1").select("item_id", F.lit("district").alias("kind"), F.col("district").alias("value"))
    long = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("headline"), F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) >= 7)
    longest = F.slice(F.array_sort(F.transform(long, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    words = items.select("item_id", F.explode(F.transform(longest, lambda x: x["w"])).alias("value"))
    person = items.filter("item_id % 10 = 3").select("item_id", F.lit("person").alias("kind"), F.concat(F.lit("p"), F.expr("cast(item_id div 50 as string)")).alias("value"))
    return district.unionByName(words.select("item_id", F.lit("string").alias("kind"), "value")).unionByName(person)


def _signed(spark, d):
    """Signatures of all items, as a table: what reads them many times doesn't read the texts again."""
    return written(E.signatures(view(spark, d, "items"), _entities(spark, d)), "signed")


@query("signatures", with_views("""select item_id, coalesce(string_agg(distinct value, ',' order by value) filter (kind = 'person'), '') persons, coalesce(string_agg(distinct value, ',' order by value) filter (kind = 'string'), '') strings
  from (select i.item_id, kind, value from items i left join entities e on e.item_id = i.item_id) group by item_id""", "items").replace("\nselect item_id, coalesce", f",\n{ENTITIES}\nselect item_id, coalesce", 1))  # fmt: skip
def signatures(spark, d):
    return _signed(spark, d).select("item_id", F.array_join("persons", ",").alias("persons"), F.array_join("strings", ",").alias("strings"))


@query("candidate_pairs", with_views("select * from pairs", "items").replace("\nselect * from pairs", f",\n{ENTITIES},\n{PAIRS}\nselect * from pairs", 1))
def candidate_pairs(spark, d):
    return E.candidate_pairs(_signed(spark, d))


def _confirmed(pairs):
    """The judgement table: every pair but those whose ids add up to a multiple of three."""
    return pairs.filter("(item_a + item_b) % 3 <> 0").select("item_a", "item_b")


@query("event_clusters", with_views("select * from (select item_id, cluster_id from reach)", "items").replace("with items", "with recursive items", 1).replace("\nselect * from (select", f""",
{ENTITIES},
{PAIRS},
links as (select item_a a, item_b b from pairs where (item_a + item_b) % 3 <> 0 union select item_b, item_a from pairs where (item_a + item_b) % 3 <> 0),
walk as (select item_id node, item_id seen from items union select w.node, l.b from walk w join links l on l.a = w.seen),
reach as (select node item_id, min(seen) cluster_id from walk group by node)
select * from (select""", 1))  # fmt: skip
def event_clusters(spark, d):
    signed = _signed(spark, d)
    return E.event_clusters(signed, _confirmed(E.candidate_pairs(signed)))


@query("cluster_locality", with_views("""select cluster_id, case when count(distinct one) = 1 then min(one) end district from (
  select cluster_id, case when i.item_id % 3 <> 1 then i.district end one from members m left join items i on i.item_id = m.item_id) group by cluster_id""", "items", "members"))  # fmt: skip
def cluster_locality(spark, d):
    m = view(spark, d, "members").select("cluster_id", "item_id")
    one = _signed(spark, d).select("item_id", "districts")
    return E.cluster_locality(m.join(one, "item_id", "left"))


@query("changed_groups", with_views("""select cluster_id, substring(sha256(string_agg(item_id || ':' || coalesce(headline, ''), chr(10) order by item_id, headline)), 1, 32) hash from members where cluster_id % 2 = 1 or cluster_id % 3 = 0 group by cluster_id""", "members"))
def changed_groups(spark, d):
    now = E.membership_hash(view(spark, d, "members"))
    before = now.filter("cluster_id % 2 = 0").withColumn("hash", F.when(F.col("cluster_id") % 3 == 0, "stale").otherwise(F.col("hash")))
    return E.changed_groups(now, before)


@query("evidence_pack", with_views("""select cluster_id, outlet, item_id, row_number() over (partition by cluster_id order by first) slot from (
  select cluster_id, outlet, min(n) as first, arg_max(item_id, n) item_id from (select *, row_number() over (partition by cluster_id order by turn, item_id, headline) n from members) group by 1, 2) qualify slot <= 6""", "members"))  # fmt: skip
def evidence_pack(spark, d):
    return E.evidence_pack(view(spark, d, "members"), [F.asc("turn"), F.asc("item_id"), F.asc("headline")])


@query("citation_links", with_views("""select cluster_id, m.marker, items_of[m.marker] item_id from (select cluster_id, list(item_id order by item_id) items_of from (select distinct cluster_id, item_id from members) group by cluster_id),
  (select unnest([1, 3, 9]) marker) m""", "members"))  # fmt: skip
def citation_links(spark, d):
    c = view(spark, d, "members").groupBy("cluster_id").agg(F.array_sort(F.collect_set("item_id")).alias("citations"))
    return E.citation_links(c.select("cluster_id", F.lit("first [1], third [3] and [3], none [9]").alias("summary")), c)


@query("person_items", with_views("select item_id, count(*) n from entities where kind = 'person' and value in ('p1', 'p3', 'p8') group by item_id", "items").replace("\nselect item_id, count", f",\n{ENTITIES}\nselect item_id, count", 1))
def person_items(spark, d):
    signed = _signed(spark, d)
    wanted = F.array(F.lit("p1"), F.lit("p3"), F.lit("p8"))
    return signed.filter(F.exists("persons", lambda p: F.array_contains(wanted, p))).select("item_id", F.size(F.array_intersect("persons", wanted)).cast("bigint").alias("n"))


@query("cluster_numbers", with_views("""select cluster_id, office_id, l_suppkey, votes from (select *, row_number() over (partition by cluster_id order by l_suppkey, office_id, votes) rn from (
    select m.cluster_id, t.office_id, t.person_id l_suppkey, f.v votes from (select distinct cluster_id, item_id person from members) m
    join tenures t on t.person_id = m.person and t.end_date is null and t.status = 'active' left join (select subject_id, max(event_id) v from facts group by 1) f on f.subject_id = t.office_id)) where rn <= 4""", "members", "first_lines", "tenures", "facts"))  # fmt: skip
def cluster_numbers(spark, d):
    from townhall.operators.offices import is_current

    persons = view(spark, d, "members").select("cluster_id", F.col("item_id").alias("person_id")).distinct()
    seats = view(spark, d, "tenures").filter(is_current()).select("person_id", "office_id")
    facts = view(spark, d, "facts").groupBy(F.col("subject_id").alias("office_id")).agg(F.max("event_id").alias("votes"))
    rows = persons.join(seats, "person_id").join(facts, "office_id", "left").withColumnRenamed("person_id", "l_suppkey")
    order = Window.partitionBy("cluster_id").orderBy("l_suppkey", "office_id", F.col("votes").asc_nulls_last())
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 4").select("cluster_id", "office_id", "l_suppkey", "votes")


# Places on a map: nations are squares of ten in a five by five grid; nation 6 is an L, nation 12 has a hole.
def _areas(spark, d):
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("area_id"), ((F.col("n_nationkey") % 5) * 10.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 10.0).alias("y"), F.col("n_regionkey").alias("region"))
    ring = lambda *ps: F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in (*ps, ps[0])))
    square, ell, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)), ring((3, 3), (3, 7), (7, 7), (7, 3))
    geom = F.when(F.col("area_id") == 6, F.array(F.array(ell))).when(F.col("area_id") == 12, F.array(F.array(square, hole))).otherwise(F.array(F.array(square)))
    return n.select("area_id", "region", geom.cast(S.GEOMETRY).alias("geom"))


def _points(spark, d):
    k = F.col("c_custkey")
    return view(spark, d, "customer").select(k.alias("point_id"), ((k * 37 % 5000) / 100.0 + 0.005).alias("x"), ((k * 91 % 5000) / 100.0 + 0.005).alias("y"))


IN_AREA = """select point_id, area_id from (select c_custkey point_id, (c_custkey * 37 % 5000) / 100.0 + 0.005 x, (c_custkey * 91 % 5000) / 100.0 + 0.005 y from customer) p
  join (select n_nationkey area_id, n_nationkey % 5 * 10 ax, n_nationkey // 5 * 10 ay from nation) a on x >= ax and x < ax + 10 and y >= ay and y < ay + 10
  where not (area_id = 6 and x - ax >= 4 and y - ay >= 4) and not (area_id = 12 and x - ax >= 3 and x - ax < 7 and y - ay >= 3 and y - ay < 7)"""


@query("point_in_polygon", IN_AREA)
def point_in_polygon(spark, d):
    return S.point_in_polygon(_points(spark, d), _areas(spark, d), 5.0)


@query("merge_polygons", f"select n_regionkey region, count(*) n_points from ({IN_AREA}) join nation on n_nationkey = area_id group by 1")
def merge_polygons(spark, d):
    whole = S.merge_polygons(_areas(spark, d), "region").withColumnRenamed("region", "area_id")
    return S.point_in_polygon(_points(spark, d), whole, 10.0).groupBy(F.col("area_id").alias("region")).agg(F.count("*").alias("n_points"))


@query("geojson_bbox", """select n_nationkey area_id, (n_nationkey % 5 * 10)::double x0, (n_nationkey // 5 * 10)::double y0, (n_nationkey % 5 * 10 + 10)::double x1, (n_nationkey // 5 * 10 + 10)::double y1 from nation""")
def geojson_bbox(spark, d):
    """Features as GeoJSON text, read back and bounded."""
    text = F.to_json(F.struct(F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))).alias("coordinates")))
    back = F.from_json(text, "coordinates array<array<array<array<double>>>>")["coordinates"]
    geom = F.transform(back, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return S.with_bounds(_areas(spark, d).select("area_id", geom.alias("geom"))).drop("geom")


def _seats(spark, d):
    """A square of two around each customer's point: most lie in one nation, some across borders."""
    p = _points(spark, d)
    x, y = F.floor("x") - 1.0, F.floor("y") - 1.0
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))))
    return p.select(F.col("point_id").alias("area_id"), F.array(F.array(ring)).cast(S.GEOMETRY).alias("geom"))


OVERLAP = """select area_id, arg_min(parent_id, (-n, parent_id)) parent_id, round(max(n) / 16.0, 4)::double share from (
  select area_id, n_nationkey parent_id, count(*) n from (select c_custkey area_id, floor((c_custkey * 37 % 5000) / 100.0 + 0.005) - 1 + i * 0.5 + 0.25 x, floor((c_custkey * 91 % 5000) / 100.0 + 0.005) - 1 + j * 0.5 + 0.25 y
    from customer, range(4) a(i), range(4) b(j)) join nation on x >= n_nationkey % 5 * 10 and x < n_nationkey % 5 * 10 + 10 and y >= n_nationkey // 5 * 10 and y < n_nationkey // 5 * 10 + 10
  where not (n_nationkey = 6 and x - 10 >= 4 and y - 10 >= 4) and not (n_nationkey = 12 and x - 20 between 3 and 7 and y - 20 between 3 and 7) group by 1, 2) group by area_id"""


@query("overlap_assign", OVERLAP)
def overlap_assign(spark, d):
    return V.overlap_assign(_seats(spark, d), _areas(spark, d), 5.0)


@query("overlap_audit", f"""select area_id, case when c_nationkey % 5 = 0 then case when share >= 0.5 then 'fill' else 'withheld' end when c_nationkey = parent_id then 'agrees'
  when c_custkey % 2 = 0 and share >= 0.97 then 'override' when share > 0.55 then 'mismatch' else 'keep' end decision from ({OVERLAP}) join customer on c_custkey = area_id""")  # fmt: skip
def overlap_audit(spark, d):
    found = V.overlap_assign(_seats(spark, d), _areas(spark, d), 5.0).join(view(spark, d, "customer"), F.col("c_custkey") == F.col("area_id"))
    assigned = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    return found.select("area_id", S.overlap_decision(F.col("share"), assigned, F.col("c_custkey") % 2 == 0, assigned == F.col("parent_id")).alias("decision"))


@query("geometry_audit", "select c_custkey area_id, case c_custkey % 3 when 0 then 'not closed' else 'no area' end problem from customer where c_custkey % 3 <> 1")
def geometry_audit(spark, d):
    k = F.col("area_id")
    at = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"))
    broken = F.when(k % 3 == 0, F.array(F.array(F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0), at(0.0, 1.0))))).when(k % 3 == 2, F.array(F.array(F.array(at(0.0, 0.0), at(1.0, 1.0), at(2.0, 2.0), at(0.0, 0.0))))).otherwise(F.col("geom"))
    return S.geometry_audit(_seats(spark, d).select("area_id", broken.alias("geom")))
