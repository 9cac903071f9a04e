"""Queries: matching of names, seats, persons and places in two scripts, rows of listings, and what feeds may show.

Names are made of the ids' digests, so that they look like words, differ, and are the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.functions import text as X
from townhall.operators import events as E
from townhall.operators import feeds as D
from townhall.operators import linkage as L
from townhall.operators import spatial as S
from townhall.operators.graph import folder_for
from townhall.operators.offices import is_current
from townhall.plans.events import ENTITIES, PAIRS, _areas, _confirmed, _seats, _signed
from townhall.plans.registry import query
from townhall.sources import markup as K
from townhall.sources.standins import view, with_views
from townhall.streaming import clusters as C
from townhall.streaming import ingest as G

LATIN, TAMIL = "aeioubdfgklmnprs", "கசடதபமயரலவளழறனநஞ"


def name_of(c: str) -> str:
    """Two words for an id."""
    h = f"sha256(cast({c} as varchar))"
    return f"(translate(substring({h}, 1, 7), '0123456789abcdef', '{LATIN}') || ' ' || translate(substring({h}, 8, 9), '0123456789abcdef', '{LATIN}'))"


def tamil_of(c: str) -> str:
    """A Tamil name for an id."""
    return f"translate(substring(sha256(cast({c} as varchar)), 20, 10), '0123456789abcdef', '{TAMIL}')"


def spark_name(c: str, form=name_of):
    return F.expr(form(c).replace("sha256(cast(", "sha2(cast(").replace(" as varchar))", " as string), 256)"))


@query("fuzzy_person", "select c_custkey, s_suppkey, round(32 / 33.0, 6)::double ratio from customer join supplier on s_suppkey = c_custkey")
def fuzzy_person(spark, d):
    """Names of customers without their last letter, to names of suppliers."""
    left = view(spark, d, "customer").select("c_custkey", F.substring(spark_name("c_custkey"), 1, 16).alias("nm"))
    right = view(spark, d, "supplier").select("s_suppkey", spark_name("s_suppkey").alias("nm"))
    return L.fuzzy_match(left, right, "c_custkey", "s_suppkey", "nm", 0.9)


@query("person_match", "select s_suppkey name_id, s_suppkey person_id, case s_suppkey % 4 when 0 then 'ratio' when 1 then 'words' else 'script' end as rule from supplier where s_suppkey % 4 <> 3")
def person_match(spark, d):
    """Names as headlines have them: with a letter less, the last word behind an honorific, Tamil with an ending, and unknown."""
    k, name, ta = F.col("s_suppkey") % 4, spark_name("s_suppkey"), spark_name("s_suppkey", tamil_of)
    persons = view(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.initcap(name).alias("name_en"), ta.alias("name_ta"))
    short = F.when(k == 0, F.substring(name, 1, 16)).when(k == 1, F.concat(F.lit("Thiru. "), F.initcap(F.substring(name, 9, 9)))).when(k == 2, F.concat(ta, F.lit("க்கு"))).otherwise("Qxy Zzvw")
    return L.person_match(view(spark, d, "supplier").select(F.col("s_suppkey").alias("name_id"), short.alias("name")), persons)


@query("seat_match", "select s_suppkey row_id, s_suppkey code, case s_suppkey % 6 when 2 then 'close' when 4 then 'containment' when 5 then null else 'exact' end as rule from supplier where s_suppkey % 6 <> 5 union all select s_suppkey, null, null from supplier where s_suppkey % 6 = 5")
def seat_match(spark, d):
    k, name, ta = F.col("s_suppkey") % 6, spark_name("s_suppkey"), spark_name("s_suppkey", tamil_of)
    seats = view(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), name.alias("name_en"), ta.alias("name_ta"))
    said = F.when(k == 0, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).when(k == 1, F.concat(F.lit("Alias "), "s_suppkey")).when(k == 2, F.substring(name, 2, 16)).when(k == 3, F.concat(ta, F.lit(" சட்டமன்றத் தொகுதி"))).when(k == 4, F.concat(ta, F.lit("வடக்கு"))).otherwise("Qxy Zzvw")
    aliases = view(spark, d, "supplier").filter("s_suppkey % 6 = 1").select(F.concat(F.lit("alias "), "s_suppkey").alias("alias"), name.alias("alias_of"))
    return L.seat_match(view(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), said.alias("seat")), seats, aliases).select("row_id", "code", "rule")


@query("listing_match", with_views(f"""select tenure_id row_id, case when tenure_id % 5 <> 0 and tenure_id % 11 <> 0 then person_id end person_id, {name_of("office_id")} seat_key,
    case when tenure_id % 5 = 0 then 'name differs' when tenure_id % 11 = 0 then 'no assets' end skipped
  from tenures where end_date is null and status = 'active' and person_id is not null and tenure_id % 7 <> 0""", "first_lines", "tenures"))  # fmt: skip
def listing_match(spark, d):
    """A row for each seated member: the name in capitals without its last letter, the seat with a reservation or misspelled; some rows are of unknown seats, of others, or without assets."""
    held = view(spark, d, "tenures").filter(is_current()).filter("person_id is not null").select("tenure_id", "person_id", spark_name("person_id").alias("name"), spark_name("office_id").alias("seat"), "office_id")
    t = F.col("tenure_id")
    seat = F.when(t % 7 == 0, "Xyzzy 12").when(t % 4 == 1, F.concat(F.substring("seat", 1, 5), F.substring("seat", 7, 20))).when(t % 3 == 0, F.concat(F.upper("seat"), F.lit(" (SC)"))).otherwise(F.col("seat"))
    rows = held.select(t.alias("row_id"), F.when(t % 5 == 0, "Zz Qq").otherwise(F.upper(F.substring("name", 1, 16))).alias("name"), seat.alias("seat"), F.when(t % 11 != 0, t).alias("assets"))
    none = spark.createDataFrame([], "alias string, alias_of string")
    return L.listing_match(rows, held.select("person_id", "name", "seat"), none).select("row_id", "person_id", "seat_key", "skipped")


@query("linkage_layers", f"""select s_suppkey code, case when s_suppkey % 6 < 4 then s_suppkey end record_id, case s_suppkey % 6 when 0 then 'name' when 1 then 'base name' when 2 then 'number' when 3 then 'close name' end layer,
    case when s_suppkey % 6 >= 4 then 'no record' end problem from supplier""")  # fmt: skip
def linkage_layers(spark, d):
    """Records that share the whole name, the base name, the number, nearly the base name, a name in another district, or nothing."""
    k, base, s = F.col("s_suppkey") % 6, spark_name("s_suppkey"), view(spark, d, "supplier")
    here, other = F.array(F.concat(F.lit("d"), "s_nationkey")), F.array(F.lit("elsewhere"))
    seats = s.select(F.col("s_suppkey").alias("code"), F.concat(base, F.lit(" seat")).alias("name"), base.alias("base"), F.col("s_suppkey").alias("number"), here.alias("districts"))
    its = F.when(k <= 1, base).when(k == 3, F.substring(base, 1, 16)).when(k == 4, base).otherwise(F.concat(F.lit("qx"), F.reverse(base)))
    ordinals = F.when(k == 2, F.array("s_suppkey")).otherwise(F.array().cast("array<long>"))
    records = s.select(F.col("s_suppkey").alias("record_id"), F.when(k == 0, F.concat(base, F.lit(" seat"))).otherwise(its).alias("name"), its.alias("base"), ordinals.alias("ordinals"), F.when(k == 4, other).when(k == 3, F.array().cast("array<string>")).otherwise(here).alias("districts"))
    return L.linkage_layers(seats, records)


@query("resolve_with_withhold", """select c_custkey, case when c_mktsegment = 'BUILDING' then 'd' || c_nationkey when n = 1 then 'w' || one when c_nationkey % 5 = 0 then null when c_acctbal >= 0 then 'old' || c_nationkey end district,
    case when c_mktsegment = 'BUILDING' then 'current' when n = 1 then 'single claim' when c_nationkey % 5 = 0 then 'withheld' when c_acctbal >= 0 then 'older source' else 'problem' end reason
  from customer left join (select o_custkey, count(distinct o_orderstatus) n, min(o_orderstatus) one from orders group by 1) on o_custkey = c_custkey""")  # fmt: skip
def resolve_with_withhold(spark, d):
    """A current source for some customers, the states of their orders for claims, and an older source that doesn't know all."""
    claims = view(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("w"), "o_orderstatus")).alias("claims"))
    c = view(spark, d, "customer").join(claims, F.col("o_custkey") == F.col("c_custkey"), "left")
    current = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("d"), "c_nationkey"))
    older = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("old"), "c_nationkey"))
    district, reason = L.resolve_district(current, F.coalesce("claims", F.array().cast("array<string>")), older, F.col("c_nationkey") % 5 == 0)
    return c.select("c_custkey", district.alias("district"), reason.alias("reason"))


PLACES = [("North", "of the"), ("North", "y los"), ("South", "der die"), ("West", "la des"), ("East", "de los"), ("Hill", "மதுரை"), ("Shore", "மது நகர்")]
WHOLE_WORD = r"(?i)(^|[^\p{L}\p{M}\p{N}_])%s($|[^\p{L}\p{M}\p{N}_])"
TAGGED = "(select item_id, coalesce(headline, '') || case item_id % 5 when 0 then ' மதுரைக்கு' when 1 then ' புதுமதுரை' when 2 then ' மது நகர்' else '' end h from items)"


def _hits_sql(names, start: bool) -> str:
    """A table (item_id, entry) of the names that stand in h of TAGGED."""
    tamil = (r"(^|[^஀-௿])%s" if start else "%s")
    each = [f"select item_id, '{e}' entry from {TAGGED} where regexp_matches(h, '{(tamil if any(ord(c) > 0x0B7F and ord(c) < 0x0C00 for c in n) else WHOLE_WORD) % n}')" for e, n in names]
    return "(" + " union ".join(each) + ")"


def _tagged(spark, d):
    k = F.col("item_id") % 5
    tail = F.when(k == 0, " மதுரைக்கு").when(k == 1, " புதுமதுரை").when(k == 2, " மது நகர்").otherwise("")
    return view(spark, d, "items").select("item_id", F.concat(F.coalesce("headline", F.lit("")), tail).alias("h"))


@query("single_place_tag", with_views(f"select i.item_id, case when count(distinct entry) = 1 then min(entry) end place from items i left join {_hits_sql(PLACES, True)} h on h.item_id = i.item_id group by i.item_id", "items"))
def single_place_tag(spark, d):
    """The one place that a text names, by whole English words or where a Tamil word begins."""
    tagged = _tagged(spark, d)
    hits = L.lexicon_matches(tagged, spark.createDataFrame(PLACES, "entry string, name string"), "h", at_word_start=True)
    return L.single_place(tagged.select("item_id").join(hits, "item_id", "left").withColumnRenamed("entry", "place"), "item_id", "place")


ENTRIES = [(f"entry {n}", n) for n in ("the", "of", "la", "der", "y", "in the", "மதுரை", "நகர்")]


@query("lexicon_hits", with_views(f"select item_id, entry from {_hits_sql(ENTRIES, False)}", "items"))
def lexicon_hits(spark, d):
    """Persons and places that texts name: English as whole words, Tamil anywhere."""
    return L.lexicon_matches(_tagged(spark, d), spark.createDataFrame(ENTRIES, "entry string, name string"), "h")


SIGNALLED = [("seat 1", "the of"), ("seat 2", "das"), ("seat 3", "los"), ("seat 4", "une"), ("seat 5", "மதுரை")]


@query("signal_seats", with_views(f"""select item_id, string_agg(distinct entry, ',' order by entry) seats from {_hits_sql(SIGNALLED, True)} where item_id in (select item_id from {TAGGED}
  where regexp_matches(case when item_id % 3 = 0 then 'Bypoll in ' || h else h end, '{X.BYPOLL}') or (regexp_matches(h, '{X.VACANCY}') and regexp_matches(h, '(?i)assembly|constituency|\\bMLA\\b|\\bseat\\b'))) group by item_id""", "items"))  # fmt: skip
def signal_seats(spark, d):
    """Seats, in either script, that the titles name which may announce a by-election."""
    tagged = _tagged(spark, d)
    signals = tagged.filter(X.is_signal(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Bypoll in "), "h")).otherwise(F.col("h"))))
    hits = L.lexicon_matches(signals, spark.createDataFrame(SIGNALLED, "entry string, name string"), "h", at_word_start=True)
    return hits.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("entry")), ",").alias("seats"))


@query("positional_rows", """select o_orderkey, case when o_orderpriority <> '5-LOW' then 'Name ' || o_custkey end name, case when o_orderpriority <> '5-LOW' then 'Party ' || o_orderstatus end party,
  case when o_orderpriority <> '5-LOW' then cast(floor(o_totalprice) as bigint) end votes from orders""")  # fmt: skip
def positional_rows(spark, d):
    """Rows of results; partial orders lack the colour's cell, and low ones have no votes."""
    n, place, name, party = F.col("o_orderkey").cast("string"), F.lit("Town"), F.concat(F.lit("Name "), "o_custkey", F.lit(" [ 4 ]")), F.concat(F.lit("Party "), "o_orderstatus", F.lit("[a]"))
    votes = F.when(F.col("o_orderpriority") == "5-LOW", "-").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    whole, short = F.array(F.lit(""), n, place, name, F.lit(""), party, votes, F.lit("51.2")), F.array(n, place, name, party, votes, F.lit("51.2"), F.lit("x"))
    found = K.positional(F.when(F.col("o_orderstatus") == "P", short).otherwise(whole), F.col("o_orderkey"))
    return view(spark, d, "orders").select("o_orderkey", found["name"].alias("name"), found["party"].alias("party"), found["votes"].alias("votes"))


@query("listing_rows", """select s_suppkey candidate_id, s_name name, 'Seat & ' || s_nationkey seat, 'P' || s_nationkey % 4 party, case when s_suppkey % 3 = 0 then 0 else s_suppkey % 5 end::bigint cases, 'Graduate' education,
  s_suppkey * 1000 + 123456 assets, case when s_suppkey % 2 = 0 then s_suppkey end liabilities from supplier""")  # fmt: skip
def listing_rows(spark, d):
    """Pages of fifty rows of a listing; a row without a link, one of seven cells, and a first row of each candidate that a later one replaces."""
    cell = lambda c: F.concat(F.lit("<td class=a>"), c, F.lit("</td>"))
    s, k = view(spark, d, "supplier"), F.col("s_suppkey")
    link = F.concat(F.lit("<a href='x.php?candidate_id="), k, F.lit("'>"), "s_name", F.lit("</a>"))
    tail = [cell(F.concat(F.lit("P"), F.col("s_nationkey") % 4)), cell(F.when(k % 3 == 0, "none").otherwise((k % 5).cast("string"))), cell(F.lit("<b>Graduate</b>")), cell(F.concat(F.lit("Rs&nbsp;"), F.format_number(k * 1000 + 123456, 0), F.lit(" ~ 1 Lacs+"))), cell(F.when(k % 2 == 0, F.concat(F.lit("Rs "), k)).otherwise("Nil"))]
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(link), cell(F.concat(F.lit("Seat &amp;\n "), "s_nationkey")), *tail, F.lit("</tr>"))
    first = F.concat(F.lit("<TR>"), cell(F.lit("1")), cell(link), *[cell(F.lit("old"))] * 6, F.lit("</TR><tr><td>no link</td></tr><tr>"), cell(link), F.lit("</tr>"))
    pages = s.groupBy(F.expr("s_suppkey div 50").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k, F.concat(first, row).alias("tr")))).alias("r"))
    return K.listing_rows(pages.select("page_id", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["tr"]), "\n"), F.lit("</table>")).alias("html")))


@query("attribute_rows", "select c_custkey number, c_name name, case c_custkey % 3 when 1 then 'SC' when 2 then 'ST' end reserved, 'North ' || c_nationkey district from customer where c_nationkey % 2 = 0")
def attribute_rows(spark, d):
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 1, " (SC)").when(k % 3 == 2, " (ST) ").otherwise(""))
    rows = view(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, " Home State").otherwise("Other").alias("state"), k.alias("number"), name.alias("name"), F.concat(F.lit("NORTH "), "c_nationkey").alias("district"))
    return K.attribute_rows(rows, "home state")


@query("series_points", with_views("select 'D' || district_id district, yr as \"year\", sum(n)::bigint boys, count(*) girls from indicators group by 1, 2", "indicators"))
def series_points(spark, d):
    """A landed payload for each year, with a row of all castes (0) and rows of parts for each district."""
    g = view(spark, d, "indicators").groupBy("district_id", F.col("yr").alias("year")).agg(F.sum("n").alias("boys"), F.count("*").alias("girls"))
    row = lambda caste, f: F.struct(F.concat(F.lit("D"), "district_id").alias("districtName"), F.lit(caste).alias("casteId"), f("boys").alias("boys"), f("girls").alias("girls"))
    each = g.select("year", F.explode(F.array(row("0", F.col), row("1", lambda c: F.floor(F.col(c) / 2)), row("2", lambda c: F.col(c) - F.floor(F.col(c) / 2)))).alias("r"))
    payloads = each.groupBy("year").agg(F.to_json(F.struct(F.collect_list("r").alias("data"))).alias("json"))  # three rows for each of the districts
    return K.series_points(payloads, ["boys", "girls"], "0")


@query("structural_rows", "select o_orderkey from orders where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT' and o_orderkey between 1 and 5000 and o_orderkey % 10 <> 7")
def structural_rows(spark, d):
    """Rows as wide as their header, without stray pipes, and with an id in its range."""
    key = F.when(F.col("o_orderkey") % 10 == 7, "n/a").otherwise(F.concat(F.lit(" "), "o_orderkey"))
    cells = F.when(F.col("o_orderstatus") == "P", F.array(key, F.lit("x"))).otherwise(F.array(key, F.when(F.col("o_orderpriority") == "1-URGENT", "a|b").otherwise(F.col("o_orderpriority")), F.lit("x")))
    return view(spark, d, "orders").filter(K.well_formed(cells, 3, F.element_at(cells, 1), 1, 5000)).select("o_orderkey")


@query("alliance_votes", "select o_orderkey, nullif(greatest(case when floor(o_totalprice) >= 10000 then floor(o_totalprice) else 0 end, case when floor(o_totalprice / 2) >= 10000 then floor(o_totalprice / 2) else 0 end), 0)::bigint votes from orders")
def alliance_votes(spark, d):
    shown = lambda c: F.format_number(F.floor(c), 0)
    cells = F.array(F.col("o_orderkey").cast("string"), F.lit("999,999,999"), shown(F.col("o_totalprice") / 2), F.lit("-"), shown(F.col("o_totalprice")), F.lit("9,999"))
    return view(spark, d, "orders").select("o_orderkey", K.largest_votes(cells).alias("votes"))


@query("language_items", with_views("select item_id from items where n_chars % 2 = 0 or lang = 'fr'", "items"))
def language_items(spark, d):
    """Items that can be shown in French: with a clean title in it, or written in it."""
    items = view(spark, d, "items").withColumn("title_fr", F.when(F.col("n_chars") % 2 == 0, F.lit("titre")))
    return items.filter(D.in_language("fr")).select("item_id")


@query("coverage_tier", with_views("select item_id, case when outlet like '%3' then 'beyond' else 'home' end tier from items", "items"))
def coverage_tier(spark, d):
    """Items of outlets of the region, and of those beyond it."""
    items = view(spark, d, "items").select("item_id", "outlet")
    beyond = items.select("outlet").distinct().filter("outlet like '%3'")
    both = [D.of_tier(items, beyond, t).select("item_id", F.lit(t).alias("tier")) for t in ("home", "beyond")]
    return both[0].unionByName(both[1])


@query("place_keys", with_views("select l.code, l.name, k.place from localities l join (select n_nationkey place, 'district:d' || (24 - n_nationkey) as key from nation union all select 100 + c_custkey, case when c_custkey % 2 = 0 then 'seat:c' else 'state:c' end || c_custkey from customer) k on k.key = l.level || ':' || l.code", "localities"))
def place_keys(spark, d):
    """Places that a reader saved as "level:code", in the reader's order; keys of another level name nothing."""
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.concat(F.lit("district:d"), 24 - F.col("n_nationkey")).alias("key"))
    c = view(spark, d, "customer").select((100 + F.col("c_custkey")).alias("place"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "seat:c").otherwise("state:c"), "c_custkey").alias("key"))
    return D.by_composite_key(view(spark, d, "localities"), n.unionByName(c)).select("code", "name", "place")


@query("json_text_order", "select event_id, row_number() over (partition by user_id order by k nulls last, event_id) place from (select *, case when event_id % 4 = 0 then null else json_extract_string(props, '$.k') end k from events)")
def json_text_order(spark, d):
    """The events of each user by a field of their JSON as text; those without it come last."""
    from pyspark.sql.window import Window

    props = F.when(F.col("event_id") % 4 == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    order = Window.partitionBy("user_id").orderBy(F.get_json_object(props, "$.k").asc_nulls_last(), "event_id")
    return view(spark, d, "events").select("event_id", F.row_number().over(order).alias("place"))


@query("feature_load", """select name, area_id, case when area_id is null then 'unknown name' when ax >= 40 then 'outside' when area_id % 6 = 5 then 'repeated' end problem from (
  select case when n_nationkey % 7 = 3 then null else n_nationkey end area_id, (case when n_nationkey % 7 = 3 then 'lost ' else 'area ' end || n_nationkey) name, n_nationkey % 5 * 10 ax, n_nationkey k from nation) a
  cross join range(2) t(i) where i = 0 or k % 6 = 5""")  # fmt: skip
def feature_load(spark, d):
    """Features of the nations' squares by name: unknown names, squares beyond the region, and areas that two features claim."""
    areas = _areas(spark, d)
    name = F.concat(F.when(F.col("area_id") % 7 == 3, "lost ").otherwise("area "), "area_id")
    features = areas.unionByName(areas.filter("area_id % 6 = 5")).select(name.alias("name"), "geom")
    aliases = areas.select(F.concat(F.lit("area "), "area_id").alias("alias"), "area_id")
    return S.load_features(features, aliases, (0.0, 0.0, 40.0, 50.0)).select("name", "area_id", "problem")


@query("geometry_coverage", """select 'district' as level, count(*) total, count(*) filter (n_nationkey % 4 <> 0) with_geometry, min(x) filter (n_nationkey % 4 <> 0) x0, max(x + 10) filter (n_nationkey % 4 <> 0) x1 from (select n_nationkey, (n_nationkey % 5 * 10)::double x from nation)
  union all select 'seat', count(*), count(*) filter (c_custkey % 2 = 1), min(x) filter (c_custkey % 2 = 1), max(x + 2) filter (c_custkey % 2 = 1) from (select c_custkey, floor((c_custkey * 37 % 5000) / 100.0 + 0.005) - 1 x from customer)
  union all select 'state', count(*), 0, null, null from region""")  # fmt: skip
def geometry_coverage(spark, d):
    """How many places of each level have a geometry, and from where to where they reach."""
    code = lambda tag: F.concat(F.lit(tag), F.col("area_id"))
    geoms = _areas(spark, d).filter("area_id % 4 <> 0").select(code("d").alias("code"), "geom").unionByName(_seats(spark, d).filter("area_id % 2 = 1").select(code("c").alias("code"), "geom"))
    return S.geometry_coverage(view(spark, d, "localities"), geoms).select("level", "total", "with_geometry", "x0", "x1")


@query("greedy_clusters", with_views("select item_id, cluster_id from (select node item_id, min(root) cluster_id from walk group by node)", "items").replace("with items", "with recursive items", 1).replace("\nselect item_id, cluster_id from (select node", f""",
{ENTITIES},
{PAIRS},
links as (select case when x.published_at < y.published_at or (x.published_at = y.published_at and item_a < item_b) then item_a else item_b end earlier, case when x.published_at < y.published_at or (x.published_at = y.published_at and item_a < item_b) then item_b else item_a end later
  from pairs join items x on x.item_id = item_a join items y on y.item_id = item_b where (item_a + item_b) % 3 <> 0),
walk as (select item_id node, item_id root from items where item_id not in (select later from links) union select l.later, w.root from walk w join links l on l.earlier = w.node)
select item_id, cluster_id from (select node""", 1))  # fmt: skip
def greedy_clusters(spark, d):
    signed = _signed(spark, d)
    return E.greedy_clusters(signed, _confirmed(E.candidate_pairs(signed)))


HALF = "epoch(published_at) >= 1704067200 + 60 * (select max(doc_id) // 2 from documents)"


def _runs(spark, d):
    """Signatures; those of the later half of items; and clusters of twenty ids of the earlier half."""
    signed = _signed(spark, d)
    n = view(spark, d, "documents").agg(F.max("doc_id").alias("n")).first()["n"] or 0
    late = F.unix_timestamp(F.col("published_at").cast("timestamp")) >= F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + 60 * (n // 2)
    return signed, signed.filter(late), signed.filter(~late).withColumn("cluster_id", F.expr("item_id div 20"))


@query("cluster_joins", with_views("select * from joined", "items").replace("\nselect * from joined", f""",
{ENTITIES},
tokens as (select distinct item_id, kind, value from entities where not (kind = 'string' and value in ('tamil nadu', 'india', 'tn', 'tamilnadu'))),
late as (select item_id, published_at from items where {HALF}),
early as (select item_id, item_id // 20 cluster_id, published_at from items where not {HALF}),
joint as (select distinct cluster_id, kind, value from tokens join early using (item_id)),
shared as (select item_id, cluster_id, count(*) filter (kind = 'person') p, count(*) filter (kind = 'string') s, count(*) filter (kind = 'district') k from tokens join late using (item_id) join joint using (kind, value) group by 1, 2),
fits as (select item_id, cluster_id from shared where p > 0 or s > 1 or (s = 1 and k > 0)),
timely as (select distinct f.item_id, f.cluster_id from fits f join late l on l.item_id = f.item_id join early e on e.cluster_id = f.cluster_id where abs(epoch(l.published_at) - epoch(e.published_at)) < 259200),
tried as (select *, row_number() over (partition by item_id order by cluster_id) rn from timely),
joined as (select item_id, min(cluster_id) cluster_id from tried where rn <= 3 and (item_id + cluster_id) % 3 <> 0 group by item_id)
select * from joined""", 1))  # fmt: skip
def cluster_joins(spark, d):
    """Items of the later half that join clusters of the earlier one: three tries each, judged by a table."""
    _, new, members = _runs(spark, d)
    return E.assign_to_clusters(new, members, _judged(new, members))


def _judged(new, members):
    """The judge's table: of all that could be asked (items and clusters that fit) those whose ids don't add up to a multiple of three."""
    return E.fitting_clusters(new, members).filter("(item_id + cluster_id) % 3 <> 0").withColumn("same", F.lit(True))


@query("cluster_runs")
def cluster_runs(spark, d):
    """The clusters after a run over the later half of items, beside those that wait."""
    signed, new, members = _runs(spark, d)
    state = E.advance_clusters(members, new, _judged(new, members), _confirmed(E.candidate_pairs(signed)), F.lit("2023-12-01 00:00:00").cast("timestamp_ntz"))
    return state.select("item_id", "cluster_id")


@query("stream_clusters")
def stream_clusters(spark, d):
    """The clusters of all items that come as a stream in slices of time, half an hour apart; what is older than seven days has ended."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=30 * F.col("item_id").cast("int"))
    signed = _signed(spark, d).withColumn("published_at", at)
    out = folder_for(spark, "stream-clusters")
    G.land_slices(signed, "published_at", f"{out}/items", 6, 4)  # about as many batches as slices, however many tasks made the rows
    state = C.ClusterState(spark, f"{out}/state")
    C.cluster_stream(G.file_stream(spark, f"{out}/items", signed.schema, 4), state, _judged, _confirmed, f"{out}/checkpoint").awaitTermination()
    return state.clusters()
