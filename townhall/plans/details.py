"""Queries: smaller pieces of feeds, portfolios, payloads and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.functions import text as X
from townhall.operators import linkage as L
from townhall.operators import merge as M
from townhall.operators.graph import folder_for
from townhall.plans.registry import query
from townhall.sources import paged as P
from townhall.sources.standins import view, with_views


@query("payload_pages", "select c_custkey // 100 page, count(*) n_records, true complete from customer group by 1")
def payload_pages(spark, d):
    """Landed pages of a hundred records (JSON with a total), exploded, and whether all pages together reach the total."""
    c = view(spark, d, "customer")
    total = c.agg(F.count("*").alias("total"))
    pages = c.groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("records")).crossJoin(F.broadcast(total))  # one row
    landed = pages.select("page", F.to_json(F.struct("total", "records")).alias("json"))
    read = landed.select("page", F.from_json("json", "total long, records array<struct<c_custkey:long,c_name:string>>").alias("p"))
    rows = read.select("page", F.col("p.total").alias("total"), F.explode("p.records").alias("r"))
    sums = rows.agg((F.count("*") >= F.max("total")).alias("complete"))
    return rows.groupBy("page").agg(F.count("*").alias("n_records")).crossJoin(F.broadcast(sums))


@query("last_in_given_order", """select k, name, place from (select s_suppkey k, s_name name, row_number() over (partition by s_nationkey order by s_suppkey desc) rn, s_nationkey place from supplier) where rn = 1""")
def last_in_given_order(spark, d):
    """The last row of each key, at the place that the caller gave the key."""
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))
    return M.last_of(s, ["place"], [F.desc("k")]).orderBy("place")


@query("source_dots", "select source, least(count(distinct outlet), 12) dots, greatest(count(distinct outlet) - 12, 0) more from (select l_orderkey source, l_partkey outlet from lineitem union all select c_nationkey, c_custkey from customer) group by source")
def source_dots(spark, d):
    """The outlets of each story, twelve of them shown: parts of an order, and customers of a nation."""
    stories = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("outlet")).union(view(spark, d, "customer").select("c_nationkey", "c_custkey"))
    n = stories.groupBy("source").agg(F.count_distinct("outlet").alias("n"))
    return n.select("source", F.least("n", F.lit(12)).alias("dots"), F.greatest(F.col("n") - 12, F.lit(0)).alias("more"))


@query("name_forms", """select c_custkey, lower(replace(c_name, '#', 'e ')) || ' st' norm, regexp_replace(c_name, '#', 'é-') titled, array_to_string(list_sort(string_split(c_custkey::varchar || ' ' || lower(c_mktsegment) || ' ' || c_nationkey, ' ')), ' ') sorted,
  'customer-' || c_custkey slug, c_mktsegment party, c_name bare, case c_nationkey % 3 when 0 then 'SC' when 1 then 'ST' end reserved from customer""")  # fmt: skip
def name_forms(spark, d):
    """Names with marks and capitals, parties with dots and footnotes, and seats with what stands behind them, made plain."""
    c, k = view(spark, d, "customer"), F.col("c_nationkey") % 3
    seat = F.concat("c_name", F.when(k == 0, " (SC)").when(k == 1, " (ST) ").otherwise(""))
    dotted = F.concat(F.regexp_replace("c_mktsegment", "(.)", "$1. "), F.lit("[ 4 ] ("))
    marked = X.norm_name(L.decomposed(F.concat(F.lit("("), F.upper(F.replace("c_name", F.lit("#"), F.lit("É "))), F.lit(") St."))))
    return c.select(
        "c_custkey", F.replace(marked, F.lit("e\u0301"), F.lit("e")).alias("norm"), X.title_case(F.upper(F.replace("c_name", F.lit("#"), F.lit("é-")))).alias("titled"), X.token_sorted(F.concat_ws(", ", "c_mktsegment", "c_custkey", "c_nationkey")).alias("sorted"),
        X.slug(F.concat(F.lit(" Customer--"), "c_custkey", F.lit("!"))).alias("slug"), X.norm_party(dotted).alias("party"), X.without_reservation(seat).alias("bare"), X.reservation(seat).alias("reserved"),
    )


@query("place_suffixes", "select c_custkey, 'North ' || c_nationkey district, c_name town, 'Ward ' || c_custkey || ' districts' kept from customer")
def place_suffixes(spark, d):
    """Names of places without what says their kind, in any case, and without their qualifiers."""
    n = F.concat(F.lit("North "), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, " DISTRICT ").otherwise(" district"))
    return view(spark, d, "customer").select("c_custkey", X.without_suffix(n, "district").alias("district"), X.before_comma(F.concat("c_name", F.lit(" , Old, State"))).alias("town"), X.without_suffix(F.concat(F.lit("Ward "), "c_custkey", F.lit(" districts")), "district").alias("kept"))


@query("published_numbers", "select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderkey % 5 / 2.0 end ratio, case when o_orderkey % 3 = 0 then 0 else o_orderkey end n from orders")
def published_numbers(spark, d):
    k = F.col("o_orderkey")
    return view(spark, d, "orders").select("o_orderkey", X.ratio_or_none((k % 5) / 2.0).alias("ratio"), X.count_or_zero(F.when(k % 3 == 0, " ").otherwise(k.cast("string"))).alias("n"))


@query("tidy_summaries", with_views("""select item_id, trim(replace(headline, '"', '')) || ' "x" y' tidy from items""", "items"))
def tidy_summaries(spark, d):
    text = F.concat(F.trim(F.replace("headline", F.lit('"'), F.lit(""))), F.lit(' \\"x\\" [1] y [23]'))
    return view(spark, d, "items").select("item_id", X.tidied(text).alias("tidy"))


@query("legacy_portfolios", """select s_suppkey, case s_suppkey % 4 when 0 then 'Health' when 1 then 'Health,Law' when 2 then 'Health,Law' else '' end names from supplier""")
def legacy_portfolios(spark, d):
    k = F.col("s_suppkey") % 4
    shapes = F.when(k == 0, '"Health"').when(k == 1, '["Health", "Law"]').when(k == 2, '[{"name": "Health", "subjects": []}, {"name": "Law"}]').otherwise('""')
    return view(spark, d, "supplier").select("s_suppkey", F.array_join(X.department_entries(shapes), ",").alias("names"))


@query("position_classes", "select s_suppkey, case when s_suppkey % 10 = 0 then 'cm' when s_suppkey % 3 = 0 then 'deputy' else 'minister' end as position from supplier")
def position_classes(spark, d):
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, "Deputy Chief Minister").otherwise("Minister for Law")
    return view(spark, d, "supplier").select("s_suppkey", X.position_class(title, k % 10 == 0).alias("position"))


@query("office_word_tripwire", "select s_suppkey from supplier where s_suppkey % 6 = 1")
def office_word_tripwire(spark, d):
    name = F.when(F.col("s_suppkey") % 6 == 1, " Speaker").otherwise("Speaker's Secretariat")
    return view(spark, d, "supplier").filter(X.is_office(name)).select("s_suppkey")


@query("department_filter", with_views("select item_id, department from items where contains(lower(department || ' ' || outlet), 'ent 3 src1')", "items"))
def department_filter(spark, d):
    text = F.lower(F.concat_ws(" ", "department", "outlet"))
    return view(spark, d, "items").filter("department is not null").filter(F.contains(text, F.lit("ent 3 src1"))).select("item_id", "department")


@query("first_image", with_views("select cluster_id, arg_min(url, (turn, item_id, headline)) filter (url is not null) image from (select m.*, case when m.turn % 2 = 1 then 'http://i/' || m.item_id end url from members m) group by cluster_id", "members"))
def first_image(spark, d):
    m = view(spark, d, "members").withColumn("image", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("http://i/"), "item_id")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "item_id", "headline", "image")))
    g = m.groupBy("cluster_id").agg(ordered.alias("m"))
    return g.select("cluster_id", F.try_element_at(F.filter("m", lambda x: x["image"].isNotNull()), F.lit(1))["image"].alias("image"))


@query("insert_ignore", with_views("select distinct cluster_id, item_id from members", "members"))
def insert_ignore(spark, d):
    m = view(spark, d, "members").select("cluster_id", "item_id")
    return M.insert_ignore(m.filter("item_id % 2 = 0").distinct(), m, ["cluster_id", "item_id"])


@query("append_corrections", """select user_id, event_id, user_id not in (select c_custkey from customer where c_custkey % 2 = 0) orphan from events where event_type = 'error'""")
def append_corrections(spark, d):
    """A log of corrections, all appended, with those whose subject isn't known."""
    subjects = view(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known")).distinct()
    log = view(spark, d, "events").filter("event_type = 'error'").select("user_id", "event_id")
    return log.join(subjects, "user_id", "left").select("user_id", "event_id", F.col("known").isNull().alias("orphan"))


@query("plausible_totals", with_views("select yr, total, total between 1000 and 10000000 plausible from (select yr, sum(n)::bigint total from indicators group by yr)", "indicators"))
def plausible_totals(spark, d):
    g = view(spark, d, "indicators").groupBy("yr").agg(F.sum("n").alias("total"))
    return g.withColumn("plausible", F.col("total").between(1000, 10_000_000))


@query("party_anchor", """select o_orderkey, case when o_orderstatus <> 'P' and o_orderpriority <> '5-LOW' then 'person ' || o_custkey end candidate from orders""")
def party_anchor(spark, d):
    """The cell after a wanted party that is no party itself, from neighbouring cells of a row; partial orders have another party there, low ones an empty cell."""
    after = F.when(F.col("o_orderstatus") == "P", "blue").when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("person "), "o_custkey"))
    row = F.array(F.lit("n"), F.lit("blue"), F.lit("red"), after, F.lit("blue"))
    return view(spark, d, "orders").select("o_orderkey", L.after_party(row, F.lit("red"), F.array(F.lit("red"), F.lit("blue"))).alias("candidate"))


@query("numeric_link_check", """select c_custkey, s_suppkey, c_nationkey = s_nationkey ok from customer join supplier on s_suppkey = c_custkey""")
def numeric_link_check(spark, d):
    """Links by number, cross-checked by another field."""
    c, s = view(spark, d, "customer"), view(spark, d, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey).select("c_custkey", "s_suppkey", (F.col("c_nationkey") == F.col("s_nationkey")).alias("ok"))


@query("reader_vacancies", with_views("""select seat, name, district_name from (select o.seat, l.name, p.name district_name, row_number() over (partition by l.district order by o.seat) rn from offices o join localities l on l.code = o.seat left join localities p on p.code = l.district
  where o.office_id not in (select office_id from tenures where end_date is null and status = 'active')) where rn <= 2""", "localities", "offices", "first_lines", "tenures"))  # fmt: skip
def reader_vacancies(spark, d):
    """Vacant seats beside their places, two for each district of a reader."""
    from townhall.operators.offices import vacant_offices, with_parents

    places = with_parents(view(spark, d, "localities"), ["state"]).select(F.col("code").alias("seat"), "name", "district", "district_name")
    vacant = vacant_offices(view(spark, d, "offices"), view(spark, d, "tenures")).join(places, "seat")
    order = Window.partitionBy("district").orderBy("seat")
    return vacant.withColumn("rn", F.row_number().over(order)).filter("rn <= 2").select("seat", "name", "district_name")


@query("working_set", with_views("select item_id from items where published_at > timestamp '2024-01-01 12:00:00' - interval 7 days and published_at <= timestamp '2024-01-01 12:00:00'", "items"))
def working_set(spark, d):
    """Items of the seven days before a moment; without a time, or later than it, they don't cluster."""
    from townhall.operators.feeds import recent

    return view(spark, d, "items").filter(recent("published_at", "2024-01-01 12:00:00", 7) & (F.col("published_at") <= F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))).select("item_id")


@query("paged_records", "select row_number() over (order by c_custkey) - 1 number, c_custkey, c_name from customer")
def paged_records(spark, d):
    """Customers landed as pages of a hundred records, read as a source that holds them against their total."""
    P.register(spark)
    path, order = folder_for(spark, "pages"), Window.orderBy("c_custkey")
    c = view(spark, d, "customer").select("c_custkey", "c_name")
    total = c.agg(F.count("*").alias("total"))
    placed = c.withColumn("n", F.row_number().over(order) - 1)  # the stand-in for a site that numbers its own records
    pages = placed.groupBy(F.expr("n div 100").alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "c_custkey", "c_name"))).alias("records")).crossJoin(F.broadcast(total))  # one row
    pages.select("page", F.to_json(F.struct("total", "records")).alias("value")).repartition("page").write.partitionBy("page").text(path)
    read = spark.read.format("paged").option("limit", 100).load(path + "/page={page}")
    return read.select("number", F.from_json("record", "c_custkey long, c_name string").alias("r")).select("number", "r.c_custkey", "r.c_name")
