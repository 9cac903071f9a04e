"""Places, offices and who holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_current() -> Column:
    return F.col("end_date").isNull() & (F.col("status") == "active")


def current_holders(offices: DataFrame, tenures: DataFrame, persons: DataFrame) -> DataFrame:
    """Every active, open tenure with its office and person; an office may have several, or none."""
    return offices.join(tenures.filter(is_current()), "office_id").join(persons, "person_id")


def vacant_offices(offices: DataFrame, tenures: DataFrame) -> DataFrame:
    return offices.join(tenures.filter(is_current()), "office_id", "left_anti")


def latest_tenure(tenures: DataFrame) -> DataFrame:
    """The last tenure of each office by start date, the larger id of equals."""
    order = Window.partitionBy("office_id").orderBy(F.col("start_date").desc_nulls_last(), F.col("tenure_id").desc())
    return tenures.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def last_holders(offices: DataFrame, tenures: DataFrame) -> DataFrame:
    """For offices without a holder, the person who resigned last."""
    resigned = latest_tenure(tenures.filter("status = 'resigned'"))
    return vacant_offices(offices, tenures).join(resigned, "office_id").select("office_id", "person_id", "end_date")


def with_parents(places: DataFrame, levels: list[str]) -> DataFrame:
    """places with the name of the district and of the parent, if the parent is of one of the levels.

    Only places of those levels are names for others, so seats, which are most places, aren't looked up in themselves."""
    named = places.select(F.col("code").alias("u_code"), F.col("name").alias("u_name"), F.col("level").alias("u_level"))
    district = named.filter("u_level = 'district'").select(F.col("u_code").alias("district"), F.col("u_name").alias("district_name"))
    parent = named.filter(F.col("u_level").isin(levels)).select(F.col("u_code").alias("parent"), F.col("u_name").alias("parent_name"))
    return places.join(district, "district", "left").join(parent, "parent", "left")


def hierarchy_gaps(places: DataFrame) -> DataFrame:
    """Rows that can't be placed: without a name, or with a parent that isn't there."""
    known = places.select(F.col("code").alias("parent"))
    nameless = places.filter(F.trim(F.coalesce("name", F.lit(""))) == "").withColumn("gap", F.lit("no name"))
    lost = places.filter("parent is not null").join(known, "parent", "left_anti").withColumn("gap", F.lit("unknown parent"))
    return nameless.select("code", "gap").unionByName(lost.select("code", "gap"))


def search_places(places: DataFrame, term: str) -> DataFrame:
    """Places whose name or district name, in either script, has the term, or whose code is the term, by their codes as numbers.

    English names in any case; the term's own wildcards count. Names: name, name_ta, district_name, district_ta, where there."""
    like = f"%{term}%"
    found = F.col("code") == term
    for c in ("name", "district_name"):
        found = found | F.coalesce(F.col(c).ilike(like), F.lit(False))
    for c in {"name_ta", "district_ta"} & set(places.columns):
        found = found | F.coalesce(F.col(c).like(like), F.lit(False))
    return places.filter(found).orderBy(F.regexp_extract("code", r"\d+", 0).try_cast("bigint"), "code")


def collisions(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
