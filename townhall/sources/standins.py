"""Views over the given tables that play the roles of the civic tables.

Each view is one SQL text for both engines; {name} stands for a table or another view. In Spark the
tables are read from Parquet, in DuckDB they are the registered views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The moment that all queries take for now, after the last event.
AS_OF = "2024-02-01 00:00:00"

VIEWS = {
    "localities": """
        select 's' || cast(r_regionkey as varchar(9)) as code, r_name as name, 'state' as level, cast(null as varchar(9)) as parent, cast(null as varchar(9)) as district from {region}
        union all select 'd' || cast(n_nationkey as varchar(9)), n_name, 'district', 's' || cast(n_regionkey as varchar(9)), cast(null as varchar(9)) from {nation}
        union all select 'c' || cast(c_custkey as varchar(9)), c_name, 'seat', 'd' || cast(c_nationkey as varchar(9)), 'd' || cast(c_nationkey as varchar(9)) from {customer}""",
    "offices": """
        select c_custkey as office_id, case when c_mktsegment = 'BUILDING' then 'mp' else 'mla' end as office_type, 'c' || cast(c_custkey as varchar(9)) as seat from {customer}""",
    "first_lines": """
        select l_orderkey, l_suppkey from (
          select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as rn from {lineitem}) x where rn = 1""",
    "tenures": """
        select o_orderkey as tenure_id, o_custkey as office_id, l_suppkey as person_id, cast(o_orderdate as date) as start_date,
          case when o_orderstatus = 'F' then cast(o_orderdate as date) end as end_date,
          case o_orderstatus when 'O' then 'active' when 'F' then 'resigned' else 'other' end as status, o_orderpriority as source
        from {orders} left join {first_lines} on l_orderkey = o_orderkey""",
    "persons": """
        select s_suppkey as person_id, s_name as name, 'party ' || cast(s_nationkey as varchar(9)) as party, s_acctbal as assets from {supplier}""",
    "facts": """
        select event_id, user_id as subject_id, event_type as fact_key, props as fact_value, event_type as source, ts as retrieved_at, value as raw_confidence from {events}""",
    "usage": """
        select event_type as source, ts as retrieved_at from {events}
        union all select o_orderpriority, o_orderdate from {orders}
        union all select l_returnflag, l_shipdate from {lineitem}""",
    "cadences": """
        select * from (values ('click', 'half-hourly'), ('view', 'hourly'), ('error', 'daily'), ('purchase', 'monthly'), ('signup', 'monthly'),
          ('1-URGENT', 'hourly'), ('2-HIGH', 'daily'), ('3-MEDIUM', 'monthly'), ('A', 'daily'), ('N', 'monthly')) as c(source, cadence)""",
    "items": """
        select d.doc_id as item_id, d.source as outlet, p.url as url, d.text as headline, d.lang as lang,
          {plus_minutes:d.doc_id} as published_at, 'd' || cast(d.doc_id % 25 as varchar(9)) as district,
          case when l.toxic = 1 then 'soft' when l.quality = 1 then 'civic' when l.quality = 0 then 'adjacent' end as civic_class,
          case when d.doc_id % 7 = 0 then 'high' when d.doc_id % 3 = 0 then 'normal' end as priority,
          case when d.doc_id % 5 = 0 then 'department ' || cast(d.doc_id % 9 as varchar(9)) end as department,
          d.n_chars as n_chars
        from {documents} d left join {pages} p on p.page_id = d.doc_id left join {labels} l on l.doc_id = d.doc_id""",
    "members": """
        select conv_id as cluster_id, turn, conv_id * 4 + turn as item_id, role as outlet, text as headline from {conversations}""",
    "indicators": """
        select l_suppkey % 25 as district_id, cast(extract(year from l_shipdate) as int) as yr, l_returnflag as level,
          cast(l_quantity as bigint) as n, l_linestatus as gender, l_orderkey as orderkey, cast(round(l_extendedprice * 100) as bigint) as paise from {lineitem}""",
}


def _text(name: str, tables, plus_minutes: str) -> str:
    def put(m: re.Match) -> str:
        key, _, argument = m[1].partition(":")
        if key == "plus_minutes":
            return plus_minutes.format(argument)
        return tables(key) if key in TABLES else f"({_text(key, tables, plus_minutes)})" + (f" as {key}" if m[2] else "")

    return re.sub(r"\{([a-z_]+(?::[a-z_.]+)?)\}(?=(\s*$|\s+on\b)?)", put, VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a stand-in view of the tables in a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plus = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({} as int), 0)"
    return spark.sql(_text(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", plus))


def with_views(body: str, *names: str) -> str:
    """body, in DuckDB's SQL, with the named views before it."""
    plus = "timestamp '2024-01-01 00:00:00' + to_minutes(cast({} as integer))"
    return "with " + ",\n".join(f"{n} as ({_text(n, lambda t: t, plus)})" for n in names) + "\n" + body
