"""Queries: upserts, quality rules, indicators, and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from townhall.operators import indicators as I
from townhall.operators import linkage as L
from townhall.operators import merge as M
from townhall.operators import quality as Q
from townhall.operators import variants as W
from townhall.plans.registry import query
from townhall.sources.standins import view, with_views

HALF = "event_id % 2"
UPSERT = f"""select coalesce(o.subject_id, n.subject_id) subject_id, coalesce(o.fact_key, n.fact_key) fact_key,
  case when n.subject_id is not null then n.fact_value else o.fact_value end fact_value, coalesce(o.first_seen, n.first_seen) first_seen, least(o.earliest, n.earliest) earliest,
  case when o.subject_id is not null and n.subject_id is not null then 'seen' when n.subject_id is not null then 'new' else 'kept' end state
from (select subject_id, fact_key, fact_value, retrieved_at first_seen, retrieved_at earliest from facts where {HALF} = 0 and subject_id % 3 <> 0
    qualify row_number() over (partition by subject_id, fact_key order by retrieved_at, event_id) = 1) o
full join (select subject_id, fact_key, fact_value, retrieved_at first_seen, retrieved_at earliest from facts where {HALF} = 1
    qualify row_number() over (partition by subject_id, fact_key order by retrieved_at desc, event_id desc) = 1) n
  on o.subject_id = n.subject_id and o.fact_key = n.fact_key"""


def _merged(spark, d):
    facts = view(spark, d, "facts").withColumns({"first_seen": F.col("retrieved_at"), "earliest": F.col("retrieved_at")})
    old = M.last_of(facts.filter(f"{HALF} = 0 and subject_id % 3 <> 0"), ["subject_id", "fact_key"], [F.asc("retrieved_at"), F.asc("event_id")])
    policies = {"fact_value": "overwrite", "first_seen": "old_else_new", "earliest": "least"}
    return M.upsert(old, facts.filter(f"{HALF} = 1"), ["subject_id", "fact_key"], policies, [F.desc("retrieved_at"), F.desc("event_id")])


@query("upsert_merge", with_views(UPSERT, "facts"))
def upsert_merge(spark, d):
    return _merged(spark, d)


@query("new_vs_seen", with_views(f"select state, count(*) n from ({UPSERT}) group by state", "facts"))
def new_vs_seen(spark, d):
    return _merged(spark, d).groupBy("state").agg(F.count("*").alias("n"))


OLD_FACTS = "(select * from facts where event_id % 2 = 0 qualify row_number() over (partition by subject_id, fact_key, source order by retrieved_at desc, event_id desc) = 1)"
NEW_FACTS = OLD_FACTS.replace("% 2 = 0", "% 2 = 1").replace("select *", "select *, case when event_id % 3 = 0 then null else raw_confidence end c")


@query("fact_upsert", with_views(f"""select coalesce(n.subject_id, o.subject_id) subject_id, coalesce(n.fact_key, o.fact_key) fact_key, coalesce(n.source, o.source) source,
    case when n.subject_id is null then o.fact_value else n.fact_value end fact_value, coalesce(n.retrieved_at, o.retrieved_at) retrieved_at, coalesce(c, o.raw_confidence) raw_confidence,
    case when n.subject_id is null then 'kept' when o.subject_id is null then 'new' else 'seen' end state
  from {OLD_FACTS} o full join {NEW_FACTS} n on o.subject_id = n.subject_id and o.fact_key = n.fact_key and o.source = n.source""", "facts"))  # fmt: skip
def fact_upsert(spark, d):
    """The facts of odd events loaded over those of even ones."""
    facts, newest = view(spark, d, "facts"), [F.desc("retrieved_at"), F.desc("event_id")]
    old = M.last_of(facts.filter("event_id % 2 = 0"), ["subject_id", "fact_key", "source"], newest)
    new = facts.filter("event_id % 2 = 1").withColumn("raw_confidence", F.when(F.col("event_id") % 3 != 0, F.col("raw_confidence")))
    return M.fact_upsert(old, new, newest)


@query("tenure_import", with_views("""select coalesce(o.tenure_id, n.tenure_id) tenure_id, coalesce(o.person_id, case when o.tenure_id is null then n.person_id end) person_id,
    case when o.tenure_id is null then n.status else o.status end status, case when o.tenure_id is null then n.end_date else o.end_date end end_date, coalesce(n.source, o.source) source
  from (select * from tenures where tenure_id % 3 <> 0) o full join (select tenure_id, person_id, null::date end_date, 'active' status, 'import' source from tenures where tenure_id % 2 = 0) n on o.tenure_id = n.tenure_id""", "first_lines", "tenures"))  # fmt: skip
def tenure_import(spark, d):
    """Tenures imported again, all as active and open: what is known keeps its status and end."""
    t = view(spark, d, "tenures")
    again = t.filter("tenure_id % 2 = 0").withColumns({"end_date": F.lit(None).cast("date"), "status": F.lit("active"), "source": F.lit("import")})
    return M.import_tenures(t.filter("tenure_id % 3 <> 0"), again).select("tenure_id", "person_id", "status", "end_date", "source")


@query("snapshot", "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'")
def snapshot(spark, d):
    """Two runs that publish a whole table each; a reader sees the last."""
    from townhall.operators.graph import folder_for

    orders, root = view(spark, d, "orders").select("o_orderkey", "o_orderstatus"), folder_for(spark, "snapshots")
    M.publish_snapshot(orders, root, 1)
    M.publish_snapshot(M.read_snapshot(spark, root).filter("o_orderstatus <> 'F'"), root, 2)
    return M.read_snapshot(spark, root)


@query("retire_missing", with_views("select event_id, subject_id, source from facts where source <> 'click' or subject_id in (select s_suppkey from supplier)", "facts"))
def retire_missing(spark, d):
    listed = view(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    return M.retire_missing(view(spark, d, "facts"), listed, "click", "subject_id").select("event_id", "subject_id", "source")


@query("reconcile", """select coalesce(l.k, s.k) k, coalesce(s.v, l.v) as value, l.v listed, case when l.k is not null and s.k is not null and l.v is not distinct from s.v then 1.0 else 0.9 end::double confidence,
  not (l.k is not null and s.k is not null and l.v is not distinct from s.v) audit
  from (select c_custkey k, cast(floor(c_acctbal / 1000) as bigint) v from customer) l full join (select o_custkey k, max(o_orderkey % 10) v from orders group by 1) s on l.k = s.k""")  # fmt: skip
def reconcile(spark, d):
    listing = view(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_acctbal") / 1000).alias("v"))
    detail = view(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.col("o_orderkey") % 10).alias("v"))
    return M.reconcile(listing, detail, "k", "v")


@query("apply_vacancies", with_views("""select t.tenure_id, case when s.sim then timestamp '2001-09-01'::date else t.end_date end end_date, case when t.end_date is not null then 'already ended' when s.sim then 'ended' else 'name differs' end outcome
  from tenures t join persons p on p.person_id = t.person_id, lateral (select t.end_date is null and t.office_id % 3 <> 1 sim) s where t.status <> 'other'""", "first_lines", "tenures", "persons"))  # fmt: skip
def apply_vacancies(spark, d):
    """Vacancies name the member; a tenure ends only if the names are alike."""
    t = view(spark, d, "tenures").filter("status <> 'other'").join(view(spark, d, "persons"), "person_id")
    hint = F.when(F.col("office_id") % 3 == 1, F.lit("quite another")).otherwise(F.lower("name"))
    alike = F.col("end_date").isNull() & (L.similarity(hint, F.lower("name")) >= 0.5)
    outcome = F.when(F.col("end_date").isNotNull(), "already ended").when(alike, "ended").otherwise("name differs")
    return t.select("tenure_id", F.when(alike, F.lit("2001-09-01").cast("date")).otherwise(F.col("end_date")).alias("end_date"), outcome.alias("outcome"))


@query("violations", with_views("""select event_id::varchar subject, 'fact_key' as rule, fact_key observed from facts where fact_key not in ('click', 'view', 'purchase')
  union all select event_id::varchar, 'confidence', (raw_confidence / 10)::varchar from facts where raw_confidence / 10 not between 0 and 1""", "facts"))  # fmt: skip
def violations(spark, d):
    facts = view(spark, d, "facts").withColumn("confidence", F.col("raw_confidence") / 10)
    return Q.violations(facts, "event_id", Q.provenance_rules({"fact_key": ["click", "view", "purchase"]}))


@query("universe_check", """select id, 'missing' problem from (select unnest(range(1, 201)) id) where id not in (select distinct user_id from events)
  union all select user_id, 'outside' from events where user_id not between 1 and 200 group by user_id
  union all select user_id, 'repeated' from events where user_id between 1 and 200 group by user_id having count(*) > 1""")  # fmt: skip
def universe_check(spark, d):
    return Q.universe_check(view(spark, d, "events"), "user_id", 1, 200)


@query("range_check", "select l_orderkey::varchar || '/' || l_linenumber || '/' || l_partkey subject, 'quantity' as rule, l_quantity::varchar observed from lineitem where l_quantity not between 0 and 45")
def range_check(spark, d):
    rows = view(spark, d, "lineitem").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"))
    return Q.violations(rows, "id", {"quantity": (F.col("l_quantity").between(0, 45), F.col("l_quantity"))})


@query("percent_check", with_views("""select district_id::varchar || '/' || yr subject, 'percent' as rule, count(*) n from (select district_id, yr, 100.0 * count(*) filter (level = 'A') / count(*) share from indicators group by 1, 2)
  where abs(share - 33.3) > 0.1 group by all""", "indicators"))  # fmt: skip
def percent_check(spark, d):
    g = view(spark, d, "indicators").groupBy("district_id", "yr").agg(F.count_if(F.col("level") == "A").alias("part"), F.count("*").alias("total"))
    g = g.withColumns({"id": F.concat_ws("/", "district_id", "yr"), "published": F.lit(33.3)})
    return Q.percent_check(g, "id", "part", "total", "published").groupBy("subject", "rule").agg(F.count("*").alias("n"))


@query("drift_check", with_views("""select o.o_orderkey, round(s, 2) summed, round(o_totalprice, 2) o_totalprice, round(abs(s - o_totalprice) / abs(o_totalprice), 4) drift
  from orders o join (select l_orderkey, sum(l_extendedprice) s from lineitem group by 1) l on l.l_orderkey = o.o_orderkey where o_totalprice = 0 or abs(s - o_totalprice) / abs(o_totalprice) > 0.01""", "facts"))  # fmt: skip
def drift_check(spark, d):
    lines = view(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = Q.drift_check(lines, view(spark, d, "orders"), "o_orderkey", "l_extendedprice", "o_totalprice")
    return out.select("o_orderkey", F.round("summed", 2).alias("summed"), F.round("o_totalprice", 2).alias("o_totalprice"), F.round("drift", 4).alias("drift"))


@query("seed_check", """select event_id::varchar subject, 'props has a forbidden character' as rule, props observed from events where contains(props, '7')
  union all select user_id::varchar, 'repeated key', count(*)::varchar from events where user_id < 0 group by user_id having count(*) > 1""")  # fmt: skip
def seed_check(spark, d):
    return Q.seed_check(view(spark, d, "events"), "event_id", ["props", "event_type"], "7")


@query("orphans", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R')")
def orphans(spark, d):
    sold = view(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return view(spark, d, "part").select("p_partkey").join(sold, "p_partkey", "left_anti")


MARKED = "substring(headline, 1, 20) || case item_id % 4 when 0 then '' when 1 then ' [1] and [2]' when 2 then ' [4]' else ' [3].' end"


@query("marker_check", with_views("select item_id, item_id % 4 in (1, 3) valid from items", "items"))
def marker_check(spark, d):
    summary = F.concat(F.expr("substring(headline, 1, 20)"), F.expr("case item_id % 4 when 0 then '' when 1 then ' [1] and [2]' when 2 then ' [4]' else ' [3].' end"))
    return view(spark, d, "items").select("item_id", Q.markers_valid(summary, F.lit(3)).alias("valid"))


@query("notes_check", with_views("select cluster_id, cluster_id % 5 not in (1, 2) valid from members group by cluster_id", "members"))
def notes_check(spark, d):
    g = view(spark, d, "members").groupBy("cluster_id").agg(F.collect_set("item_id").alias("sources"))
    noted = F.when(F.col("cluster_id") % 5 == 1, F.slice("sources", 2, 1000)).when(F.col("cluster_id") % 5 == 2, F.concat("sources", F.slice("sources", 1, 1))).otherwise(F.col("sources"))
    return g.select("cluster_id", Q.notes_valid(F.col("sources"), noted).alias("valid"))


@query("lock_escalation", with_views("""select item_id, case when item_id % 11 = 0 then 'communal' when item_id % 2 = 0 then 'communal' when item_id % 3 = 0 then 'sub_judice' when item_id % 5 = 0 then 'allegations' end category from items""", "items"))
def lock_escalation(spark, d):
    k = F.col("item_id")
    return view(spark, d, "items").select(k, Q.lock_category(k % 2 == 0, k % 3 == 0, k % 5 == 0, F.when(k % 11 == 0, "communal")).alias("category"))


VERDICTS = """(select cluster_id, turn attempt, headline title, length(headline) % 3 = 1 passes,
  case when contains(headline, 'tion') then 'sub_judice' when contains(headline, 'ing') then 'communal' when contains(headline, 'ß') then 'other' end lock_ground from members)"""


@query("publish_gate", with_views(f"""select cluster_id, coalesce(good.attempt, last_one) attempt, case when good is null then 'withhold' else 'publish' end outcome, good.title title, case least_lock when 1 then 'communal' when 2 then 'sub_judice' end lock_category from (
    select cluster_id, min(case when passes then {{'attempt': attempt, 'title': title}} end) good, max(attempt) last_one, min(case lock_ground when 'communal' then 1 when 'sub_judice' then 2 end) least_lock from {VERDICTS} group by cluster_id)""", "members"))  # fmt: skip
def publish_gate(spark, d):
    """Drafts are the members of a cluster in turn; a verdict goes by its length, a lock by a word."""
    m = view(spark, d, "members")
    ground = F.when(F.contains("headline", F.lit("tion")), "sub_judice").when(F.contains("headline", F.lit("ing")), "communal").when(F.contains("headline", F.lit("ß")), "other")
    verdicts = m.select("cluster_id", F.col("turn").alias("attempt"), (F.length("headline") % 3 == 1).alias("passes"), ground.alias("lock_ground"))
    return Q.publish_gate(m.select("cluster_id", F.col("turn").alias("attempt"), F.col("headline").alias("title")), verdicts, ["communal", "sub_judice", "allegations"])


@query("rollup_sum", with_views("select yr, sum(n)::bigint n, sum(paise)::bigint paise from indicators group by yr", "indicators"))
def rollup_sum(spark, d):
    return I.rollup_sum(view(spark, d, "indicators"), ["yr"], ["n", "paise"])


@query("level_buckets", with_views("""select district_id, gender, sum(case when level in ('A', 'N') then n else 0 end)::bigint lower_level, sum(case when level = 'R' then n else 0 end)::bigint upper_level, sum(n)::bigint total
  from indicators group by district_id, gender""", "indicators"))  # fmt: skip
def level_buckets(spark, d):
    return I.level_buckets(view(spark, d, "indicators"), ["district_id", "gender"], "level", "n", {"lower_level": ["A", "N"], "upper_level": ["R"]})


def _series(spark, d):
    return I.series(I.rollup_sum(view(spark, d, "indicators"), ["district_id", "yr"], ["n", "paise"]), ["district_id"], "yr", ["n", "paise"])


@query("indicator_series", with_views("select district_id, string_agg(yr || ':' || n, ',' order by yr) points from (select district_id, yr, sum(n)::bigint n from indicators group by 1, 2) group by district_id", "indicators"))
def indicator_series(spark, d):
    return _series(spark, d).select("district_id", F.array_join(F.transform("series", lambda p: F.concat_ws(":", p["year"], p["n"])), ",").alias("points"))


@query("latest_point", with_views("select district_id, max(yr) as yr, arg_max(n, yr) n from (select district_id, yr, sum(n)::bigint n from indicators group by 1, 2) group by district_id", "indicators"))
def latest_point(spark, d):
    return _series(spark, d).select("district_id", I.latest()["year"].alias("yr"), I.latest()["n"].alias("n"))


@query("facility_share", with_views("select district_id, yr, round(count(*) filter (gender = 'F') * 100.0 / count(*), 2)::double share from indicators group by 1, 2", "indicators"))
def facility_share(spark, d):
    g = view(spark, d, "indicators").groupBy("district_id", "yr").agg(F.count_if(F.col("gender") == "F").alias("part"), F.count("*").alias("total"))
    return g.select("district_id", "yr", I.share_percent(F.col("part"), F.col("total")).alias("share"))


@query("year_panel", with_views("""select a.district_id, a.yr, a.n, b.lines from (select district_id, yr, sum(n)::bigint n from indicators group by 1, 2) a
  left join (select district_id, yr, count(*) lines from indicators where level = 'R' group by 1, 2 having count(*) % 2 = 0) b on a.district_id = b.district_id and a.yr = b.yr""", "indicators"))  # fmt: skip
def year_panel(spark, d):
    rows = view(spark, d, "indicators")
    lines = rows.filter("level = 'R'").groupBy("district_id", "yr").agg(F.count("*").alias("lines")).filter("lines % 2 = 0")
    return I.year_panel(I.rollup_sum(rows, ["district_id", "yr"], ["n"]), lines, ["district_id", "yr"])


NAMES = """rows as (select c_custkey, case when c_nationkey % 4 = 0 then 'alias ' || c_nationkey when c_nationkey % 7 = 1 then 'lost' else 'nation ' || c_nationkey end nm from customer)"""


def _named(spark, d):
    k = F.col("c_nationkey")
    rows = view(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("alias "), k)).when(k % 7 == 1, F.lit("lost")).otherwise(F.concat(F.lit("nation "), k)).alias("nm"))
    nation = view(spark, d, "nation").select("n_nationkey")
    names = nation.select(F.concat(F.lit("nation "), "n_nationkey").alias("name_key"), F.col("n_nationkey").alias("code"))
    aliases = nation.select(F.concat(F.lit("alias "), "n_nationkey").alias("name_key"), F.concat(F.lit("nation "), "n_nationkey").alias("alias_of"))
    return L.alias_join(rows, names, aliases, "nm")


@query("alias_join", f"with {NAMES} select c_custkey, nm, n_nationkey code from rows left join nation on nm = 'nation ' || n_nationkey or nm = 'alias ' || n_nationkey")
def alias_join(spark, d):
    return _named(spark, d).select("c_custkey", "nm", "code")


@query("alias_unmatched", f"with {NAMES} select nm, count(*) n from rows where nm = 'lost' group by nm")
def alias_unmatched(spark, d):
    return _named(spark, d).filter("code is null").groupBy("nm").agg(F.count("*").alias("n"))


@query("validated_join", """select o_orderkey, case when s = o then 1.0 when o <> 0 and abs(s - o) / abs(o) <= 0.01 then 0.9 end::double confidence from (
  select o_orderkey, cast(floor(o_totalprice) as bigint) s, case when o_orderkey % 3 = 0 then cast(floor(o_totalprice) as bigint) when o_orderkey % 3 = 1 then cast(floor(o_totalprice) as bigint) + 500 end o from orders)""")  # fmt: skip
def validated_join(spark, d):
    ours = view(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("votes"))
    k = F.col("o_orderkey") % 3
    theirs = ours.filter(k != 2).select("o_orderkey", F.when(k == 0, F.col("votes")).otherwise(F.col("votes") + 500).alias("votes"))
    return L.validated_join(ours, theirs, "o_orderkey", "votes").select("o_orderkey", "confidence")


@query("two_signal_check", "select o_orderkey, case when o_orderstatus = 'O' and o_totalprice > 200000 then 1.0 when o_orderstatus = 'O' or o_totalprice > 200000 then 0.9 end::double confidence from orders")
def two_signal_check(spark, d):
    return view(spark, d, "orders").select("o_orderkey", L.two_signal(F.col("o_orderstatus") == "O", F.col("o_totalprice") > 200000).alias("confidence"))


@query("bilingual_merge", """select coalesce(a.k, b.k) k, a.v name_en, b.v name_ta, case when a.v is not null and b.v is not null then 1.0 else 0.9 end::double confidence
  from (select s_suppkey k, s_name v from supplier where s_suppkey % 3 <> 0) a full join (select s_suppkey k, upper(s_name) v from supplier where s_suppkey % 4 <> 0) b on a.k = b.k""")  # fmt: skip
def bilingual_merge(spark, d):
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return L.bilingual_merge(s.filter("k % 3 <> 0"), s.filter("k % 4 <> 0").withColumn("name", F.upper("name")), "k")


@query("unique_claims", """select l_orderkey, l_partkey from (select distinct l_orderkey, l_partkey from lineitem) p
  qualify count(*) over (partition by l_orderkey) = 1 and count(*) over (partition by l_partkey) = 1""")  # fmt: skip
def unique_claims(spark, d):
    return L.unique_claims(view(spark, d, "lineitem"), "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey")


@query("source_priority", """select k, arg_min(v, (p, v)) as value, min(p) priority from (
  select o_custkey k, o_orderpriority v, case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end p from orders where o_orderpriority <> '5-LOW') group by k""")  # fmt: skip
def source_priority(spark, d):
    rows = view(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("priority"))
    return L.first_valid(rows, "k", "priority", F.col("value") != "5-LOW")


@query("election_results", """select office, winner, votes, runner_up, votes - next_v margin, total, candidates from (
  select l_orderkey office, arg_max(l_suppkey, v) filter (rn = 1) winner, max(v) filter (rn = 1) votes, max(l_suppkey) filter (rn = 2) runner_up, max(v) filter (rn = 2) next_v, sum(v)::bigint total, count(*) candidates
  from (select *, row_number() over (partition by l_orderkey order by v desc, l_suppkey) rn, count(*) over (partition by l_orderkey, v) ties from (
    select l_orderkey, l_suppkey, sum(cast(floor(l_extendedprice) as bigint))::bigint v from lineitem where l_returnflag <> 'N' group by 1, 2)) group by l_orderkey having max(case when rn = 1 then ties end) = 1)""")  # fmt: skip
def election_results(spark, d):
    """Winner, runner-up, margin and total of each office; a tie at the top is no result; 'N' plays none of the above."""
    from pyspark.sql.window import Window

    votes = view(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("office"), "l_suppkey").agg(F.sum(F.floor("l_extendedprice")).alias("v"))
    office = Window.partitionBy("office")
    ranked = votes.withColumn("rn", F.row_number().over(office.orderBy(F.desc("v"), "l_suppkey"))).withColumn("ties", F.count("*").over(Window.partitionBy("office", "v")))
    at = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    g = ranked.groupBy("office").agg(at(1, "l_suppkey").alias("winner"), at(1, "v").alias("votes"), at(2, "l_suppkey").alias("runner_up"), at(2, "v").alias("second"), F.sum("v").alias("total"), F.count("*").alias("candidates"), at(1, "ties").alias("ties"))
    return g.filter("ties = 1").select("office", "winner", "votes", "runner_up", (F.col("votes") - F.col("second")).alias("margin"), "total", "candidates")


@query("layered_linkage", """with exact as (select c_custkey a, s_suppkey b from customer join supplier on c_custkey = s_suppkey where c_nationkey = s_nationkey),
  near as (select c_custkey a, s_suppkey b from customer join supplier on c_custkey % 1000 = s_suppkey where c_custkey not in (select a from exact) and s_suppkey not in (select b from exact))
  select a, b, 0 layer from exact union all select a, b, 1 from (select * from near qualify count(*) over (partition by a) = 1 and count(*) over (partition by b) = 1)""")  # fmt: skip
def layered_linkage(spark, d):
    c, s = view(spark, d, "customer"), view(spark, d, "supplier")
    exact = c.join(s, (c.c_custkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b"))
    near = c.join(s, (c.c_custkey % 1000) == s.s_suppkey).select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b"))
    return L.layered([exact, near], "a", "b")


@query("first_per_key", "select l_orderkey, l_partkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1")
def first_per_key(spark, d):
    return M.last_of(view(spark, d, "lineitem"), ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


#: Shapes of facts by key; other keys have none.
SHAPES = {"click": "struct<count:bigint not null,total:bigint>", "view": "bigint", "error": "string", "purchase": "array<bigint>"}


def _payloads(spark, d):
    """The events as facts of mixed shapes: each fifth has another shape than its key's, each fifth no value, and each seventh of the rest no JSON."""
    k = F.col("event_id")
    n = k.cast("string")
    good = F.when(F.col("event_type") == "click", F.concat(F.lit('{"count": '), n, F.lit(', "total": '), (2 * k).cast("string"), F.lit(', "more": [1]}'))).when(F.col("event_type") == "view", n).when(F.col("event_type") == "error", F.concat(F.lit('"e'), n, F.lit('"'))).otherwise(F.concat(F.lit("["), n, F.lit(", 1]")))
    bad = F.when(F.col("event_type") == "click", F.lit('{"count": "x"}')).when(F.col("event_type") == "view", F.lit('"7"')).when(F.col("event_type") == "error", F.lit("12")).otherwise(F.lit('[1, "2"]'))
    text = F.when(k % 5 == 3, F.lit(None)).when(k % 7 == 6, F.lit("{not JSON")).when(k % 5 == 4, bad).otherwise(good)
    return view(spark, d, "events").select(k.alias("subject_id"), F.col("event_type").alias("fact_key"), text.alias("fact_value"))


@query("variant_facts", """select event_id subject_id, event_type fact_key, case event_type when 'click' then event_id when 'view' then event_id when 'purchase' then event_id + 1 end n, case when event_type = 'click' then 2 * event_id end total, case when event_type = 'error' then 'e' || event_id end words
  from events where event_type in ('click', 'view', 'error', 'purchase') and event_id % 5 not in (3, 4) and event_id % 7 <> 6""")  # fmt: skip
def variant_facts(spark, d):
    """Every fact that has its key's shape, read as that shape; arrays are added up."""
    facts = W.with_variant(_payloads(spark, d))
    of = {key: F.when(F.col("fact_key") == key, W.typed(F.col("v"), ddl)) for key, ddl in SHAPES.items()}
    read = facts.select("subject_id", "fact_key", *(c.alias(key) for key, c in of.items())).filter(" or ".join(f"{key} is not null" for key in SHAPES))
    n = F.coalesce("click.count", "view", F.aggregate("purchase", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return read.select("subject_id", "fact_key", n.alias("n"), F.col("click.total").alias("total"), F.col("error").alias("words"))


@query("fact_shape_problems", """select event_id subject_id, event_type fact_key, case when event_id % 5 = 3 then 'no value' when event_id % 7 = 6 then 'no JSON' when event_type not in ('click', 'view', 'error', 'purchase') then 'unknown key' else 'wrong shape' end problem
  from events where event_id % 5 in (3, 4) or event_id % 7 = 6 or event_type not in ('click', 'view', 'error', 'purchase')""")  # fmt: skip
def fact_shape_problems(spark, d):
    return W.shape_problems(_payloads(spark, d), SHAPES).select("subject_id", "fact_key", "problem")
