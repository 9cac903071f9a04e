"""Queries: freshness, coverage, offices and holders."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.operators import offices as O
from townhall.operators import reports as R
from townhall.plans.registry import query
from townhall.sources.standins import AS_OF, view, with_views

FRESH = f"""select source, max(retrieved_at) last_retrieved, count(*) n_rows,
  round(date_diff('second', max(retrieved_at), timestamp '{AS_OF}') / 3600.0, 2) age_hours from usage group by source"""


@query("freshness", with_views(FRESH, "usage"))
def freshness(spark, d):
    return R.freshness(view(spark, d, "usage"), AS_OF)


@query("sla_status", with_views(f"""select f.source, age_hours, n_rows, cadence,
  case when cadence is null then 'onDemand'
    when age_hours >= case cadence when 'half-hourly' then 24 when 'hourly' then 24 when 'daily' then 96 when 'monthly' then 1800 end then 'stalled'
    when age_hours >= case cadence when 'half-hourly' then 3 when 'hourly' then 6 when 'daily' then 48 when 'monthly' then 1080 end then 'late'
    else 'current' end status
  from ({FRESH}) f left join cadences c on c.source = f.source""", "usage", "cadences"))  # fmt: skip
def sla_status(spark, d):
    fresh = R.freshness(view(spark, d, "usage"), AS_OF)
    return R.sla_status(fresh, view(spark, d, "cadences")).select("source", "age_hours", "n_rows", "cadence", "status").orderBy(R.status_rank(F.col("status")), "source")


@query("pool_stats", with_views("""select count(*) total, count(*) filter (civic_class = 'soft') soft,
  count(*) filter (civic_class is null) unclassified from items""", "items"))  # fmt: skip
def pool_stats(spark, d):
    return R.pool_stats(view(spark, d, "items"))


@query("run_report", with_views("""select outlet, count(*) n_items, count(*) filter (item_id % 4 <> 0) n_new, count(*) filter (item_id % 4 = 0) n_seen,
  count(department) n_tagged, count(*) filter (url is null) n_errors from items group by outlet""", "items"))  # fmt: skip
def run_report(spark, d):
    items = view(spark, d, "items")
    return R.run_report(items, items.filter("item_id % 4 = 0").select("item_id"))


@query("current_holders", with_views("""select o.office_id, o.office_type, t.tenure_id, t.start_date, p.person_id, p.name, p.party
  from offices o join tenures t on t.office_id = o.office_id and t.end_date is null and t.status = 'active' join persons p on p.person_id = t.person_id""",
  "first_lines", "offices", "tenures", "persons"))
def current_holders(spark, d):
    held = O.current_holders(view(spark, d, "offices"), view(spark, d, "tenures"), view(spark, d, "persons"))
    return held.select("office_id", "office_type", "tenure_id", "start_date", "person_id", "name", "party")


@query("composition", with_views("""select party, count(*) seats from offices o join tenures t on t.office_id = o.office_id and t.end_date is null and t.status = 'active'
  join persons p on p.person_id = t.person_id group by party""", "first_lines", "offices", "tenures", "persons"))  # fmt: skip
def composition(spark, d):
    return O.current_holders(view(spark, d, "offices"), view(spark, d, "tenures"), view(spark, d, "persons")).groupBy("party").agg(F.count("*").alias("seats"))


@query("composition_sources", with_views("""select source, max(start_date) latest, count(*) n from tenures
  where end_date is null and status = 'active' group by source""", "first_lines", "tenures"))  # fmt: skip
def composition_sources(spark, d):
    return view(spark, d, "tenures").filter(O.is_current()).groupBy("source").agg(F.max("start_date").alias("latest"), F.count("*").alias("n"))


@query("vacant_offices", with_views("""select office_id, seat from offices o where not exists (
  select 1 from tenures t where t.office_id = o.office_id and t.end_date is null and t.status = 'active')""", "first_lines", "offices", "tenures"))  # fmt: skip
def vacant_offices(spark, d):
    return O.vacant_offices(view(spark, d, "offices"), view(spark, d, "tenures")).select("office_id", "seat")


@query("vacant_seats", with_views("""select o.office_id, o.seat, f.fact_key, count(*) n_facts from offices o join facts f on f.subject_id = o.office_id where not exists (
  select 1 from tenures t where t.office_id = o.office_id and t.end_date is null and t.status = 'active') group by all""", "first_lines", "offices", "tenures", "facts"))  # fmt: skip
def vacant_seats(spark, d):
    vacant = O.vacant_offices(view(spark, d, "offices"), view(spark, d, "tenures"))
    facts = view(spark, d, "facts").withColumnRenamed("subject_id", "office_id")
    return vacant.join(facts, "office_id").groupBy("office_id", "seat", "fact_key").agg(F.count("*").alias("n_facts"))


@query("latest_tenure", with_views("""select tenure_id, office_id, start_date, status from tenures
  qualify row_number() over (partition by office_id order by start_date desc nulls last, tenure_id desc) = 1""", "first_lines", "tenures"))  # fmt: skip
def latest_tenure(spark, d):
    return O.latest_tenure(view(spark, d, "tenures")).select("tenure_id", "office_id", "start_date", "status")


@query("last_holders", with_views("""select office_id, person_id, end_date from (select * from tenures where status = 'resigned'
    qualify row_number() over (partition by office_id order by start_date desc nulls last, tenure_id desc) = 1) t
  where office_id not in (select office_id from tenures where end_date is null and status = 'active')""", "first_lines", "tenures"))  # fmt: skip
def last_holders(spark, d):
    return O.last_holders(view(spark, d, "offices"), view(spark, d, "tenures"))


@query("seat_detail", with_views("""select s.code, s.name, p.name district_name, q.name parent_name from localities s
  left join localities p on p.code = s.district left join localities q on q.code = s.parent and q.level = 'state'""", "localities"))  # fmt: skip
def seat_detail(spark, d):
    return O.with_parents(view(spark, d, "localities"), ["state"]).select("code", "name", "district_name", "parent_name")


@query("place_cards", with_views("""select s.code, s.level, o.office_id, count(t.tenure_id) n_holders from localities s
  left join offices o on o.seat = s.code and o.office_type = case when length(s.code) % 2 = 0 then 'mp' else 'mla' end
  left join tenures t on t.office_id = o.office_id and t.end_date is null and t.status = 'active' group by all""", "localities", "first_lines", "offices", "tenures"))  # fmt: skip
def place_cards(spark, d):
    places, offices, held = view(spark, d, "localities"), view(spark, d, "offices"), view(spark, d, "tenures").filter(O.is_current())
    kind = F.when(F.length("code") % 2 == 0, "mp").otherwise("mla")
    cards = places.join(offices, (F.col("seat") == F.col("code")) & (F.col("office_type") == kind), "left").join(held, "office_id", "left")
    return cards.groupBy("code", "level", "office_id").agg(F.count("tenure_id").alias("n_holders"))


@query("facts_with_source", with_views("""select subject_id, fact_key, fact_value, retrieved_at, cadence from facts f join cadences c on c.source = f.source""", "facts", "cadences"))
def facts_with_source(spark, d):
    return view(spark, d, "facts").join(view(spark, d, "cadences"), "source").select("subject_id", "fact_key", "fact_value", "retrieved_at", "cadence")


@query("seats_of_district", with_views("""select s.code, s.name, p.name district_name from localities s join localities p on p.code = s.district where s.level = 'seat'
  order by p.name, try_cast(substring(s.code, 2) as int)""", "localities"))  # fmt: skip
def seats_of_district(spark, d):
    seats = O.with_parents(view(spark, d, "localities").filter("level = 'seat' or level = 'district'"), []).filter("level = 'seat' and district_name is not null")
    return seats.select("code", "name", "district_name").orderBy("district_name", F.expr("try_cast(substring(code, 2) as int)"))


@query("segments_of_parent", with_views("""select p.code parent, p.name parent_name, count(*) n_segments, min(s.name) first_segment from localities s join localities p on p.code = s.parent group by all""", "localities"))
def segments_of_parent(spark, d):
    named = O.with_parents(view(spark, d, "localities"), ["state", "district"]).filter("parent_name is not null")
    return named.groupBy("parent", "parent_name").agg(F.count("*").alias("n_segments"), F.min("name").alias("first_segment"))


@query("hierarchy_load", with_views("""select code, 'unknown parent' gap from (select * from localities where code <> 'd3') s
  where parent is not null and parent not in (select code from localities where code <> 'd3')
  union all select code, 'no name' from localities where code <> 'd3' and (name is null or trim(name) = '')""", "localities"))  # fmt: skip
def hierarchy_load(spark, d):
    return O.hierarchy_gaps(view(spark, d, "localities").filter("code <> 'd3'"))


@query("seat_search", with_views("""select s.code, s.name, p.name district_name from localities s left join localities p on p.code = s.district and p.level = 'district'
  where s.name ilike '%00001%' or p.name ilike '%00001%' or s.code = '00001' or contains(s.code, 'c7')""", "localities"))  # fmt: skip
def seat_search(spark, d):
    """A term in names, in either script, or codes; the local names are made of the codes."""
    places = O.with_parents(view(spark, d, "localities"), ["state"]).withColumn("name_ta", F.when(F.contains("code", F.lit("c7")), F.concat(F.lit("ஊர் 00001 "), "code")))
    return O.search_places(places, "00001").select("code", "name", "district_name")


@query("person_search", with_views("""select distinct p.person_id, p.name, p.party from tenures t join persons p on p.person_id = t.person_id
  where t.end_date is null and t.status = 'active' and p.name ilike '%00%1%' order by p.name, p.person_id limit 6""", "first_lines", "tenures", "persons"))  # fmt: skip
def person_search(spark, d):
    held = view(spark, d, "tenures").filter(O.is_current()).join(view(spark, d, "persons").filter(F.col("name").ilike("%00%1%")), "person_id")
    return held.select("person_id", "name", "party").distinct().orderBy("name", "person_id").limit(6)


@query("collisions", with_views("""select person_id, count(*) n from tenures where end_date is null and status = 'active' group by person_id having count(*) > 1""", "first_lines", "tenures"))
def collisions(spark, d):
    return O.collisions(view(spark, d, "tenures").filter(O.is_current()), "person_id")


@query("coverage_by_level", with_views("""select level, count(district) with_district, count(*) total, min(code) first_code, max(code) last_code from localities group by level""", "localities"))
def coverage_by_level(spark, d):
    return view(spark, d, "localities").groupBy("level").agg(F.count("district").alias("with_district"), F.count("*").alias("total"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


@query("last_checked", with_views(f"""select fact_key, max(retrieved_at) last_run, count(*) > 0 any_row from facts group by fact_key""", "facts"))  # noqa: F541
def last_checked(spark, d):
    return view(spark, d, "facts").groupBy("fact_key").agg(F.max("retrieved_at").alias("last_run"), (F.count("*") > 0).alias("any_row"))


@query("ministers", with_views("""select p.person_id, p.name, f.fact_value, o.seat from facts f join persons p on p.person_id = f.subject_id
  join tenures t on t.person_id = p.person_id and t.end_date is null and t.status = 'active' join offices o on o.office_id = t.office_id where f.fact_key = 'error'""", "first_lines", "offices", "tenures", "persons", "facts"))  # fmt: skip
def ministers(spark, d):
    facts = view(spark, d, "facts").filter("fact_key = 'error'").withColumnRenamed("subject_id", "person_id")
    held = view(spark, d, "tenures").filter(O.is_current()).join(view(spark, d, "offices"), "office_id")
    return facts.join(view(spark, d, "persons"), "person_id").join(held, "person_id").select("person_id", "name", "fact_value", "seat")
