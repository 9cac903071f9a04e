"""Freshness, coverage and composition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours from which a source of a cadence is late, and stalled. Fixed values.
SLA_HOURS = {"half-hourly": (3, 24), "hourly": (6, 24), "daily": (48, 96), "monthly": (1080, 1800)}
SLA_ORDER = ["stalled", "late", "current", "onDemand"]


def age_hours(at: Column, as_of: str) -> Column:
    return F.timestamp_diff("SECOND", at, F.lit(as_of).cast("timestamp_ntz")) / 3600.0


def freshness(usage: DataFrame, as_of: str) -> DataFrame:
    """source, last_retrieved, n_rows, age_hours of every source that any row uses (source, retrieved_at)."""
    used = usage.groupBy("source").agg(F.max("retrieved_at").alias("last_retrieved"), F.count("*").alias("n_rows"))
    return used.withColumn("age_hours", F.round(age_hours(F.col("last_retrieved"), as_of), 2))


def sla_status(fresh: DataFrame, cadences: DataFrame) -> DataFrame:
    """fresh with cadence and status: stalled or late at the cadence's hours, else current; onDemand without cadence."""
    late, stalled = (F.element_at(F.create_map(*(F.lit(x) for k, v in SLA_HOURS.items() for x in (k, float(v[i])))), F.col("cadence")) for i in (0, 1))
    status = F.when(F.col("cadence").isNull() | late.isNull(), "onDemand").when(F.col("age_hours") >= stalled, "stalled").when(F.col("age_hours") >= late, "late").otherwise("current")
    return fresh.join(cadences, "source", "left").withColumn("status", status)


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SLA_ORDER)), status)


def pool_stats(items: DataFrame) -> DataFrame:
    """One row: all items, soft ones, and those without a class."""
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("civic_class") == "soft").alias("soft"), F.count_if(F.col("civic_class").isNull()).alias("unclassified"))


def run_report(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items, new ones, tagged ones and errors (no url) of each outlet; seen: item ids known before."""
    known = seen.select(F.col("item_id"), F.lit(1).alias("known"))
    return (
        items.join(known, "item_id", "left")
        .groupBy("outlet")
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(F.col("known").isNull()).alias("n_new"),
            F.count("known").alias("n_seen"),
            F.count("department").alias("n_tagged"),
            F.count_if(F.col("url").isNull()).alias("n_errors"),
        )
    )
