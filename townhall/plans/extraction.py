"""Queries: extraction jobs over documents of markup, and the streaming jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.functions import text as X
from townhall.operators.graph import folder_for
from townhall.plans.registry import query
from townhall.sources import markup as K
from townhall.sources.standins import view
from townhall.streaming import health as H
from townhall.streaming import ingest as G


@query("feed_items", """select page_id feed_id, k place, 'Item ' || page_id || '/' || k title, 'http://a.example/' || page_id || '/' || k url, case when page_id % 2 = 0 then 'Mon, 1 Jan 2024 10:00:00 GMT' else '2024-01-01T10:00:00Z' end published,
  case when page_id % 2 = 0 and k = 0 then 'http://a.example/i.jpg' end image from pages, range(3) t(k) where k < 2 and page_id % 7 <> 3""")  # fmt: skip
def feed_items(spark, d):
    """RSS and Atom documents made of the pages' ids: a third entry has no title, an enclosure is audio; each seventh isn't well-formed."""
    n = F.col("page_id").cast("string")
    rss = lambda k, extra: F.concat(F.lit("<item><title> Item  "), n, F.lit(f"/{k} </title>" + ("<link>http://a.example/" if k == 0 else "<link> </link><guid>http://a.example/")), n, F.lit(f"/{k}" + ("</link>" if k == 0 else "</guid>") + f"<pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate>{extra}</item>"))
    atom = lambda k: F.concat(F.lit("<entry><title>Item "), n, F.lit(f"/{k}</title><link rel='self' href='http://b.example'/><link rel='alternate' href='http://a.example/"), n, F.lit(f"/{k}'/><updated>2024-01-01T10:00:00Z</updated></entry>"))
    empty = "<item><title> </title><link>http://a.example/none</link></item>"
    xml = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<rss><channel><title>Feed</title>"), rss(0, "<enclosure url='http://a.example/i.jpg' type='image/jpeg'/>"), rss(1, "<enclosure url='http://a.example/a.mp3' type='audio/mpeg'/>"), F.lit(empty + "</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed>"), atom(0), atom(1), F.lit("<entry><title/><link href='http://a.example/none'/></entry></feed>"))
    )
    whole = F.when(F.col("page_id") % 7 == 3, F.replace(xml, F.lit("Item"), F.lit("R & D <b"))).otherwise(xml)
    return K.feed_items(view(spark, d, "pages").select(F.col("page_id").alias("feed_id"), whole.alias("xml")))


@query("page_excerpts")
def page_excerpts(spark, d):
    return K.page_excerpts(view(spark, d, "pages"))


def _tables(spark, d):
    """Pages of fifty suppliers with two tables of results: the second has the ids of supplier rows and votes of over 1000."""
    rows = view(spark, d, "supplier").select(F.expr("s_suppkey div 50").alias("page_id"), F.concat(F.lit("<tr><td>"), "s_suppkey", F.lit("</td><td rowspan='1' colspan='2'>"), "s_name", F.lit("</td><td>"), (F.col("s_suppkey") * 10 + 5000), F.lit("</td></tr>")).alias("tr"), "s_suppkey")
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "tr"))), lambda x: x["tr"]), "").alias("b"))
    first = "<table><tr><th rowspan='2'>a</th><th>b</th></tr><tr><td>c</td></tr><tr><td>d</td><td rowspan='3'>e</td></tr></table>"
    return body.select("page_id", F.concat(F.lit(f"<p>x</p>{first}<table>"), "b", F.lit("</table>")).alias("html"))


@query("table_grid", """select page_id, tbl, r as row, c as col, text from (
    select p.page_id, 0 tbl, g.r, g.c, g.text from (select distinct s_suppkey // 50 page_id from supplier) p, (values (0, 0, 'a'), (0, 1, 'b'), (1, 0, 'a'), (1, 1, 'c'), (2, 0, 'd'), (2, 1, 'e')) g(r, c, text)
    union all select s_suppkey // 50, 1, row_number() over (partition by s_suppkey // 50, t.c order by s_suppkey) - 1, t.c, case t.c when 0 then s_suppkey::varchar when 3 then (s_suppkey * 10 + 5000)::varchar else s_name end from supplier, (select unnest([0, 1, 2, 3]) c) t)""")  # fmt: skip
def table_grid(spark, d):
    return K.table_grid(_tables(spark, d))


@query("table_select", "select s_suppkey // 50 page_id, 1 tbl, 0 col, count(*) covered from supplier group by 1")
def table_select(spark, d):
    ids = view(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return K.table_select(K.table_grid(_tables(spark, d)), ids)


@query("anchored_extract", """select o_orderkey, case when o_orderkey % 4 = 0 then null else 'Party ' || o_orderstatus end party, case when o_orderkey % 4 = 0 then null else 'Name ' || o_custkey end name from orders""")
def anchored_extract(spark, d):
    votes = F.floor("o_totalprice")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.lit("-")).otherwise(F.format_number(votes, 0))
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("Name "), "o_custkey"), F.lit("17"), F.concat(F.lit("Party "), "o_orderstatus"), F.lit(""), shown, F.lit("later"))
    near = K.anchored(cells, votes)
    return view(spark, d, "orders").select("o_orderkey", F.try_element_at(near, F.lit(1)).alias("party"), F.try_element_at(near, F.lit(2)).alias("name"))


@query("column_calibration", "select n_name party, n_nationkey % 3 col from nation join supplier on s_nationkey = n_nationkey where n_nationkey % 5 <> 4 group by 1, 2 having count(*) >= 3")
def column_calibration(spark, d):
    s = view(spark, d, "supplier").join(view(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda k: F.when((F.col("n_nationkey") % 3 == k) & (F.col("n_nationkey") % 5 != 4), F.col("s_name")).otherwise(F.lit("-"))
    grid = s.select(F.col("s_suppkey").alias("row_id"), F.array(name(0), name(1), name(2)).alias("cells"))
    return K.column_calibration(grid, s.select(F.col("n_name").alias("party"), F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name")))


@query("detail_fields", """select c_custkey, c_custkey % 4 cases, cast(floor(abs(c_acctbal) * 100) as bigint) assets, case when c_custkey % 3 = 0 then null else 20 + c_custkey % 60 end age, c_mktsegment profession from customer""")
def detail_fields(spark, d):
    """Fields of a declaration's text by pattern; an absent one is null."""
    age = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Age: "), 20 + F.col("c_custkey") % 60))
    text = F.concat(F.lit("No. of Cases: "), F.col("c_custkey") % 4, F.lit(" Assets: Rs "), F.format_number(F.floor(F.abs("c_acctbal") * 100), 0), F.lit(" ~ 3 Lacs+ "), age, F.lit(" Profession: "), "c_mktsegment", F.lit("."))
    get = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    rows = view(spark, d, "customer").withColumn("t", text)
    return rows.select("c_custkey", get(r"Cases:\s*(\d+)").cast("bigint").alias("cases"), X.parse_rupees("t").alias("assets"), get(r"Age:\s*(\d+)").cast("bigint").alias("age"), get(r"Profession:\s*([^.]+)").alias("profession"))


@query("bindings_collapse", """select l_partkey item, arg_max(l_returnflag || l_linestatus, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) label, string_agg(distinct l_returnflag, ',' order by l_returnflag) districts, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) ordinals from lineitem group by l_partkey""")
def bindings_collapse(spark, d):
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = view(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), place.alias("place"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_returnflag").alias("dist"), F.col("l_linenumber").cast("string").alias("ord"))
    return K.bindings_collapse(rows)


@query("portfolio_split", """select s_suppkey person_id, d.department, case when s_suppkey % 3 = 1 then 'Minister' else 'Finance, Health,Finance' end subjects from supplier,
  lateral (select unnest(case s_suppkey % 3 when 0 then ['Finance', 'Health'] when 1 then ['Minister'] else ['Revenue', 'Relief'] end) department) d""")  # fmt: skip
def portfolio_split(spark, d):
    k = F.col("s_suppkey") % 3
    cells = view(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.lit("minister").alias("position"), F.when(k == 2, F.array(F.lit("Revenue"), F.lit("Relief"))).otherwise(F.array().cast("array<string>")).alias("names"), F.when(k == 1, "Minister").otherwise("Finance, Health,Finance").alias("text"))
    return K.portfolio_split(cells)


@query("department_cards", """select department, string_agg(person_id::varchar, ',' order by r, person_id) holders, count(*) n from (
  select s_suppkey person_id, 'department ' || (s_suppkey // 8 + k) department, case when s_suppkey % 4 = 0 then 0 when s_suppkey % 4 = 1 then 1 else 2 end r from supplier, range(2) t(k)) group by department""")  # fmt: skip
def department_cards(spark, d):
    """Holders of each department, of which every person has two: chief minister, deputies, ministers, then by id."""
    k = F.col("s_suppkey")
    people = view(spark, d, "supplier").select(k.alias("person_id"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).otherwise(2).alias("r"), F.explode(F.array(F.expr("s_suppkey div 8"), F.expr("s_suppkey div 8 + 1"))).alias("d"))
    g = people.groupBy(F.concat(F.lit("department "), "d").alias("department")).agg(F.array_sort(F.collect_list(F.struct("r", "person_id"))).alias("h"), F.count("*").alias("n"))
    return g.select("department", F.array_join(F.transform("h", lambda x: x["person_id"].cast("string")), ",").alias("holders"), "n")


@query("registry_load", "select n_nationkey, n_name, n_regionkey, 1 n from nation")
def registry_load(spark, d):
    """The nations as a registry file (one array of objects), loaded with its unique key checked."""
    path = folder_for(spark, "registry")
    one = view(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value"))  # a registry is a small file
    one.write.text(path)
    return K.registry_load(spark, path, "n_nationkey", "n_nationkey long, n_name string, n_regionkey long").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"), F.col("n").cast("int"))


#: Slices of time that the events land in.
SLICES = 4
#: The least lateness that this allows: a slice, in whole hours, and one more.
LATE_SQL = f"to_hours(cast(ceil(epoch(max(ts) - min(ts)) / 3600 / {SLICES}) as bigint) + 1)"


def _events(spark, d):
    """The events as a folder of files for streams, landed by slices of time; the files' schema, and the lateness."""
    e = view(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = folder_for(spark, "event-files")
    hours = G.land_slices(e, "ts", path, SLICES)
    return path, e.schema, f"{math.ceil(hours) + 1} hours"


@query("stream_upsert", """select user_id, event_type, props, first_seen from (select user_id, event_type, props, min(ts) over (partition by user_id, event_type) first_seen,
  row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1""")  # fmt: skip
def stream_upsert(spark, d):
    path, schema, _ = _events(spark, d)
    rows = G.file_stream(spark, path, schema).withColumns({"first_seen": F.col("ts"), "last_seen": F.struct("ts", "event_id")})
    out = folder_for(spark, "stream-upsert")
    state = G.KeyedState(spark, f"{out}/state", "user_id long, event_type string, props string, first_seen timestamp, last_seen struct<ts:timestamp,event_id:long>", ["user_id", "event_type"], buckets=8)
    policies = {"props": "overwrite", "first_seen": "least", "last_seen": "overwrite"}
    first = F.min("ts").over(Window.partitionBy("user_id", "event_type"))
    G.upsert_stream(rows, state, policies, [F.desc("last_seen")], f"{out}/checkpoint", "last_seen", lambda batch: batch.withColumn("first_seen", first)).awaitTermination()
    return state.read().select("user_id", "event_type", "props", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query("stream_metrics", "select count(*) n_items, count(*) filter (event_type = 'error') n_errors from events")
def stream_metrics(spark, d):
    """What the micro-batches of a run report, added up."""
    path, schema, _ = _events(spark, d)
    out = folder_for(spark, "stream-metrics")
    rows = G.metered(G.file_stream(spark, path, schema), "health", F.col("event_type") == "error")
    start = lambda: rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    progress = H.recorded(spark, f"{out}/progress", start)
    return G.batch_metrics(progress, "health").agg(F.sum("n_items").alias("n_items"), F.sum("n_errors").alias("n_errors"))


@query("stream_dedupe", "select distinct substring(sha256(event_type || props), 1, 12) key from events")
def stream_dedupe(spark, d):
    path, schema, _ = _events(spark, d)
    keyed = G.file_stream(spark, path, schema).withColumn("key", X.digest_key(F.concat("event_type", "props")))
    return G.drained(G.deduped(keyed, ["key"], "ts", "60 days").select("key"), "stream-dedupe")


@query("stream_pairs", """select a.event_id id_a, b.event_id id_b, a.user_id || a.props token from events a join events b on a.user_id = b.user_id and a.props = b.props and a.event_id < b.event_id
  and b.ts > a.ts - interval 72 hours and b.ts < a.ts + interval 72 hours""")  # fmt: skip
def stream_pairs(spark, d):
    path, schema, late = _events(spark, d)
    rows = lambda: G.file_stream(spark, path, schema).select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat("user_id", "props").alias("token"))
    return G.drained(G.pair_stream(rows(), rows(), 72, late), "stream-pairs")


@query("stream_windows", f"""select time_bucket(interval 1 day, ts) as start, event_type, count(*) n from events group by 1, 2 having time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) - {LATE_SQL} from events)""")
def stream_windows(spark, d):
    path, schema, late = _events(spark, d)
    counts = G.windowed_counts(G.file_stream(spark, path, schema), "ts", "1 day", late, ["event_type"])
    return G.drained(counts, "stream-windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_working_set", "select event_id, user_id from events")
def stream_working_set(spark, d):
    """Items as they come, within seven days of the newest: the month's first events, sent again at its end under new ids, are left out.

    What is late is decided by the watermark of the batch before, so they are a slice older than the seven days."""
    path, schema, late = _events(spark, d)
    events = view(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg(F.max("ts").alias("end"))
    again = events.crossJoin(F.broadcast(end)).filter("ts < end - interval 16 days").withColumn("event_id", -1 - F.col("event_id")).drop("end")
    again.select(*schema.names).write.mode("append").parquet(path)
    return G.drained(G.deduped(G.file_stream(spark, path, schema), ["event_id"], "ts", "7 days").select("event_id", "user_id"), "stream-working-set")
