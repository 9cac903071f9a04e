"""Queries: text and address functions, feeds, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.functions import text as X
from townhall.operators import feeds as D
from townhall.operators import linkage as L
from townhall.plans.registry import query
from townhall.sources.standins import view, with_views

NOT_SOFT = "(civic_class is null or civic_class <> 'soft')"
SUBJECTS = "(" + " or ".join(f"regexp_matches(headline, '{p}')" for p in X.CIVIC_SUBJECTS.values()) + ")"
SCORE = f"case when priority = 'high' then 3.0 when priority is null and {SUBJECTS} then 2.0 else 0.0 end + case when district in ('d1', 'd2') then 1.5 else 0.0 end"
SAVED = ["d1", "d2"]


@query("localized_title", with_views("""select item_id, coalesce(case when lang = 'en' then headline end, case when lang <> 'en' then lower(headline) end, outlet) title,
  lang <> 'en' other_language from items""", "items"))  # fmt: skip
def localized_title(spark, d):
    items = view(spark, d, "items")
    mine, other = F.when(F.col("lang") == "en", F.col("headline")), F.when(F.col("lang") != "en", F.lower("headline"))
    return items.select("item_id", F.coalesce(mine, other, "outlet").alias("title"), (F.col("lang") != "en").alias("other_language"))


MARKED = """'  ' || replace(url, 'http', 'HTTP') || case when contains(url, '?') and not contains(url, '#') then '&UTM_Source=x&q=a%20b+c%2Fd&&gclid=1&flag' when not contains(url, '#') then '?FBCLID=9' else '' end || ' '"""
_AGAIN = "replace(url_encode(url_decode(replace({}, '+', ' '))), '%20', '+')"


@query("canonical_url", f"""select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(split_part(u, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end canonical
  from (select page_id, u, case when contains(u, '?') then list_transform(list_filter(string_split(regexp_replace(u, '^[^?]*\\?', ''), '&'),
    lambda p: p <> '' and not regexp_matches(lower(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '{X.TRACKING}')),
    lambda p: {_AGAIN.format("split_part(p, '=', 1)")} || '=' || case when contains(p, '=') then {_AGAIN.format("regexp_replace(p, '^[^=]*=', '')")} else '' end) end kept
  from (select page_id, split_part(trim({MARKED}), '#', 1) u from pages))""")  # fmt: skip
def canonical_url(spark, d):
    return view(spark, d, "pages").withColumn("u", F.expr(MARKED)).select("page_id", X.canonical_url("u").alias("canonical"))


@query("url_scope_filter", "select page_id, url from pages where starts_with(url, 'https://') or starts_with(url, 'http://th')")
def url_scope_filter(spark, d):
    prefixes = F.array(F.lit("https://"), F.lit("http://th"))
    return view(spark, d, "pages").filter(X.in_scope("url", prefixes)).select("page_id", "url")


@query("section_filter", f"""select page_id, s.section from pages, (select unnest(['sports', 'news', 'videos', 'fr', 'ipl-2024']) section) s
  where not regexp_matches('/' || s.section || substring(url, 8), '{X.SECTIONS}')""")  # fmt: skip
def section_filter(spark, d):
    sections = F.explode(F.array(*map(F.lit, ["sports", "news", "videos", "fr", "ipl-2024"])))
    pages = view(spark, d, "pages").select("page_id", "url", sections.alias("section"))
    return pages.filter(~X.is_section(F.concat(F.lit("/"), "section", F.expr("substring(url, 8)")))).select("page_id", "section")


@query("signal_filter", with_views(f"""select item_id from (select item_id, case item_id % 4 when 0 then 'Bypoll in ' || headline when 1 then 'MLA resigns, ' || headline when 2 then headline || ' vacancy' else headline end t from items)
  where regexp_matches(t, '{X.BYPOLL}') or (regexp_matches(t, '{X.VACANCY}') and regexp_matches(t, '(?i)assembly|constituency|\\bMLA\\b|\\bseat\\b'))""", "items"))  # fmt: skip
def signal_filter(spark, d):
    k = F.col("item_id") % 4
    title = F.when(k == 0, F.concat(F.lit("Bypoll in "), "headline")).when(k == 1, F.concat(F.lit("MLA resigns, "), "headline")).when(k == 2, F.concat("headline", F.lit(" vacancy"))).otherwise(F.col("headline"))
    return view(spark, d, "items").filter(X.is_signal(title)).select("item_id")


@query("civic_subject", with_views(f"""select item_id, array_to_string([x for x in [{', '.join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in X.CIVIC_SUBJECTS.items())}] if x is not null], ',') subjects
  from (select item_id, headline || case item_id % 6 when 0 then ' election verdict' when 1 then ' flood' when 2 then ' ration tariff' when 3 then ' cabinet' else '' end t from items)""", "items"))  # fmt: skip
def civic_subject(spark, d):
    k = F.col("item_id") % 6
    tail = F.when(k == 0, " election verdict").when(k == 1, " flood").when(k == 2, " ration tariff").when(k == 3, " cabinet").otherwise("")
    return view(spark, d, "items").select("item_id", F.array_join(X.civic_subjects(F.concat("headline", tail)), ",").alias("subjects"))


@query("parse_when", """select event_id, date_trunc('second', ts) parsed_mail, date_trunc('second', ts) parsed_iso, date_trunc('second', ts) parsed_zone, date_trunc('minute', ts) parsed_short, null::timestamp bad from events""")
def parse_when(spark, d):
    e = view(spark, d, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp_ntz")))
    zone, short = F.col("at") - F.expr("interval 5 hours"), F.col("at") + F.expr("interval 330 minutes")
    mail = F.date_format("at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    back = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), X.parse_when(c).cast("timestamp_ntz"))
    return e.select("event_id", back(mail).alias("parsed_mail"), back(iso).alias("parsed_iso"), back(F.date_format(zone, "d MMM yy HH:mm:ss 'EST'")).alias("parsed_zone"), back(F.date_format(short, "EEE, dd MMM yyyy HH:mm '+0530 (IST)'")).alias("parsed_short"), back(F.lit("yesterday")).alias("bad"))


@query("digest_key", "select page_id, substring(sha256(url), 1, 12) key from pages")
def digest_key(spark, d):
    return view(spark, d, "pages").select("page_id", X.digest_key("url").alias("key"))


@query("parse_rupees", "select o_orderkey, cast(floor(o_totalprice) as bigint) amount, '2 Crore+' tail, null::bigint absent from orders")
def parse_rupees(spark, d):
    whole = F.floor("o_totalprice")
    text = F.concat(F.lit("Rs "), F.format_number(whole, 0), F.lit(" ~ 2 Crore+"))
    return view(spark, d, "orders").select("o_orderkey", X.parse_rupees(text).alias("amount"), X.approximate_tail(text).alias("tail"), X.parse_rupees(F.lit("Nil")).alias("absent"))


@query("inr_compact", """select o_orderkey, case when a >= 10000000 then '₹' || regexp_replace(printf('%.2f', round(a / 10000000, 2)), '\\.?0+$', '') || ' crore'
    when a >= 100000 then '₹' || regexp_replace(printf('%.2f', round(a / 100000, 2)), '\\.?0+$', '') || ' lakh' else '₹' || format('{:,}', a) end shown
  from (select o_orderkey, cast(floor(o_totalprice) as bigint) * (o_orderkey % 90) a from orders)""")  # fmt: skip
def inr_compact(spark, d):
    amount = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 90)
    return view(spark, d, "orders").select("o_orderkey", X.inr_compact(amount).alias("shown"))


@query("saved_places", """select c_custkey, case when c_custkey % 5 = 0 then '' else 'district:' || c_nationkey || ',ac:' || c_custkey end places from customer""")
def saved_places(spark, d):
    text = F.when(F.col("c_custkey") % 5 == 0, "not json").otherwise(F.format_string('["district:%d", "x:1", "ac:%d", "ac:q"]', "c_nationkey", "c_custkey"))
    return view(spark, d, "customer").select("c_custkey", F.array_join(X.saved_places(text), ",").alias("places"))


@query("title_accept", with_views("""select item_id, trim(headline) title_en, case when item_id % 3 = 0 then 'தமிழ் ' || trim(headline) end title_ta from items""", "items"))
def title_accept(spark, d):
    ta = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("தமிழ் "), F.trim("headline"))).otherwise(F.col("headline"))
    return view(spark, d, "items").select("item_id", X.accepted_title("headline", "en").alias("title_en"), X.accepted_title(ta, "ta").alias("title_ta"))


@query("unclustered_items", with_views("select item_id, outlet from items where item_id not in (select item_id from members)", "items", "members"))
def unclustered_items(spark, d):
    return view(spark, d, "items").join(view(spark, d, "members").select("item_id"), "item_id", "left_anti").select("item_id", "outlet")


@query("cluster_members", with_views("""select cluster_id, count(*) n_members, count(distinct outlet) outlets, string_agg(turn::varchar, ',' order by turn) turns, bool_or(turn > 3) long
  from members group by cluster_id having count(*) >= 2""", "members"))  # fmt: skip
def cluster_members(spark, d):
    g = view(spark, d, "members").groupBy("cluster_id").agg(
        F.count("*").alias("n_members"), F.count_distinct("outlet").alias("outlets"), F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("turns"), F.bool_or(F.col("turn") > 3).alias("long")
    )
    return g.filter("n_members >= 2")


@query("civic_rank", with_views(f"select item_id, ({SCORE})::double score from items order by score desc, published_at desc, item_id", "items"))
def civic_rank(spark, d):
    return D.civic_rank(view(spark, d, "items"), SAVED).select("item_id", "score")


@query("feed_tiers", with_views(f"""select item_id, place, case when place <= 12 then 'top' else 'more' end tier from (
  select item_id, row_number() over (order by {SCORE} desc, published_at desc, item_id) place from items where {NOT_SOFT}) where place <= 27""", "items"))  # fmt: skip
def feed_tiers(spark, d):
    return D.feed_tiers(view(spark, d, "items").filter(D.not_soft()), SAVED).select("item_id", "place", "tier")


@query("district_pools", with_views(f"""select item_id, district, place from (select item_id, district, row_number() over (partition by district order by published_at desc nulls last, item_id) place
  from items where {NOT_SOFT}) where place <= 5""", "items"))  # fmt: skip
def district_pools(spark, d):
    return D.top_per_key(view(spark, d, "items").filter(D.not_soft()), "district", 5).select("item_id", "district", "place")


SECTIONED = "(select *, district || ' ' || strftime(published_at, '%Y-%m-%d') section from items)"


@query("section_fill", with_views(f"""select item_id, section, place from (
    select i.item_id, i.section, coalesce(n, 0) n, row_number() over (partition by i.section order by published_at desc nulls last, i.item_id) place
    from {SECTIONED} i left join (select section, count(distinct cluster_id) n from members m join {SECTIONED} s on s.item_id = m.item_id group by section) t on t.section = i.section
    where i.item_id not in (select item_id from members)) where place <= greatest(0, 5 - n)""", "items", "members"))  # fmt: skip
def section_fill(spark, d):
    """A section is what a district has on a day; those full of clusters leave no slots."""
    items = view(spark, d, "items").withColumn("section", F.concat_ws(" ", "district", F.date_format("published_at", "yyyy-MM-dd")))
    clusters = view(spark, d, "members").select("cluster_id", "item_id").join(items.select("item_id", "section"), "item_id")
    return D.section_fill(clusters, items, "section").select("item_id", "section", "place")


@query("feed_interleave", with_views("""select kind, id, newest from (select 'item' kind, item_id id, published_at newest from items
  union all select 'cluster', cluster_id, max(published_at) from members join items using (item_id) group by cluster_id) order by newest desc nulls last, kind, id limit 40""", "items", "members"))  # fmt: skip
def feed_interleave(spark, d):
    items = view(spark, d, "items")
    clusters = view(spark, d, "members").select("cluster_id", "item_id").join(items, "item_id").groupBy("cluster_id").agg(F.max("published_at").alias("newest"))
    return D.interleave(clusters, items, 40)


@query("feed_fallback", with_views("""select district, item_id, false fallback from own union all
  select k.code, o.item_id, true from (select * from items where priority = 'high' order by published_at desc, item_id limit 5) o, (select code from localities where level = 'district' and code not in (select district from own)) k""", "items", "localities").replace("\nselect district", ",\nown as (select * from items where n_chars > 12000)\nselect district", 1))  # fmt: skip
def feed_fallback(spark, d):
    items = view(spark, d, "items").select("item_id", "district", "published_at", "priority", "n_chars")
    keys = view(spark, d, "localities").filter("level = 'district'").select(F.col("code").alias("district"))
    other = items.filter("priority = 'high'").orderBy(F.desc("published_at"), "item_id").limit(5)
    return D.with_fallback(items.filter("n_chars > 12000"), other, keys, "district", 5).select("district", "item_id", "fallback")


@query("daily_brief", with_views("""select cluster_id, outlets, newest, priority from (select cluster_id, count(distinct m.outlet) outlets, max(published_at) newest, bool_or(priority = 'high') priority
  from members m join items i on i.item_id = m.item_id group by cluster_id having count(distinct m.outlet) >= 2) order by priority desc nulls last, outlets desc, newest desc nulls last, cluster_id limit 5""", "items", "members"))  # fmt: skip
def daily_brief(spark, d):
    m = view(spark, d, "members").select("cluster_id", "item_id", F.col("outlet").alias("voice")).join(view(spark, d, "items"), "item_id")
    g = m.groupBy("cluster_id").agg(F.count_distinct("voice").alias("outlets"), F.max("published_at").alias("newest"), F.bool_or(F.col("priority") == "high").alias("priority"))
    return D.daily_brief(g.filter("outlets >= 2"))


@query("capped_backlog", with_views("""select item_id, place, true backlog from (select item_id, row_number() over (order by published_at desc nulls last, item_id) place from items) where place <= 100""", "items"))
def capped_backlog(spark, d):
    return D.capped(view(spark, d, "items"), [F.col("published_at").desc_nulls_last(), F.asc("item_id")], 100).select("item_id", "place", "backlog")


@query("qa_sample", with_views("select item_id, outlet from items order by sha256('qa' || item_id::varchar), item_id limit 20", "items"))
def qa_sample(spark, d):
    return D.sample_rows(view(spark, d, "items"), "item_id", 20, "qa").select("item_id", "outlet")


@query("story_search", with_views("""select kind, id from (select 0 k, 'cluster' kind, cluster_id id, max(turn)::bigint n from members where headline ilike '%tion%' group by cluster_id
  union all select 1, 'item', item_id, n_chars from (select * from items where headline ilike '%tion%' order by published_at desc, item_id limit 6)) order by k, n desc, id limit 8""", "items", "members"))  # fmt: skip
def story_search(spark, d):
    hit = F.col("headline").ilike("%tion%")
    clusters = view(spark, d, "members").filter(hit).groupBy(F.col("cluster_id").alias("id")).agg(F.max("turn").cast("bigint").alias("at")).select(F.lit(0).alias("k"), F.lit("cluster").alias("kind"), "id", "at")
    items = view(spark, d, "items").filter(hit).orderBy(F.desc("published_at"), "item_id").limit(6).select(F.lit(1).alias("k"), F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("n_chars").alias("at"))
    return clusters.unionByName(items).orderBy("k", F.desc("at"), "id").limit(8).select("kind", "id")


@query("tracked_outlets", with_views("select distinct outlet from items", "items"))
def tracked_outlets(spark, d):
    return view(spark, d, "items").select("outlet").distinct()


@query("department_tags", with_views("select department tag from items where department is not null union select upper(department) from items where department is not null", "items"))
def department_tags(spark, d):
    items = view(spark, d, "items").filter("department is not null")
    return items.select(F.col("department").alias("tag")).union(items.select(F.upper("department"))).distinct()


@query("department_news", with_views(f"""select item_id, department, published_at from items where department in ('department 2', 'department 5') and {NOT_SOFT}
  and published_at > timestamp '2024-01-31 00:00:00' - interval 31 days order by published_at desc, item_id limit 50""", "items"))  # fmt: skip
def department_news(spark, d):
    items = view(spark, d, "items").filter(F.col("department").isin("department 2", "department 5")).filter(D.not_soft() & D.recent("published_at", "2024-01-31 00:00:00", 31))
    return items.orderBy(F.desc("published_at"), "item_id").limit(50).select("item_id", "department", "published_at")


@query("department_match", with_views("""select c.card, t.tag from (select distinct 'the department of ' || translate(substring(department, 12), '0123456789', '０１２３４５６７８９') card from items where department is not null) c,
  (select distinct department tag from items where department is not null) t where contains(translate(trim(substring(c.card, 19)), '０１２３４５６７８９', '0123456789'), trim(substring(t.tag, 12)))""", "items"))  # fmt: skip
def department_match(spark, d):
    names = view(spark, d, "items").filter("department is not null").select("department").distinct()
    card = names.select(F.concat(F.lit("the department of "), F.translate(F.expr("substring(department, 12)"), "0123456789", "０１２３４５６７８９")).alias("card")).withColumn("c", X.norm_department(L.compatible("card")))
    tag = names.withColumnRenamed("department", "tag").withColumn("t", X.norm_department(L.compatible("tag")))
    loose = F.contains("c", "t") | F.contains("t", "c")
    return card.join(tag, (F.col("c") != "") & (F.col("t") != "") & loose).select("card", "tag")


@query("coverage_gaps", with_views("""select c.cluster_id, o.outlet from (select distinct cluster_id from members) c, (select distinct outlet from items) o
  where not exists (select 1 from members m join items i on i.item_id = m.item_id where m.cluster_id = c.cluster_id and i.outlet = o.outlet)""", "items", "members"))  # fmt: skip
def coverage_gaps(spark, d):
    items, members = view(spark, d, "items"), view(spark, d, "members").select("cluster_id", "item_id")
    outlets = items.agg(F.collect_set("outlet").alias("all"))  # the registry of outlets: a few rows
    covered = members.join(items.select("item_id", "outlet"), "item_id", "left").groupBy("cluster_id").agg(F.collect_set("outlet").alias("there"))
    return covered.crossJoin(F.broadcast(outlets)).select("cluster_id", F.explode(F.array_except("all", "there")).alias("outlet"))
