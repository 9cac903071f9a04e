"""Indicator series: rollups, level buckets, latest points and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(points: DataFrame, keys: list[str], year: str, values: list[str]) -> DataFrame:
    """The points of each key as one array, years ascending."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("year"), *values))).alias("series"))


def latest(column: str = "series") -> Column:
    return F.try_element_at(F.col(column), F.lit(-1))


def share_percent(part: Column, total: Column, places: int = 2) -> Column:
    """part of total as a percentage; null where there is no total."""
    return F.round(F.try_divide(part * 100.0, total), places)


def rollup_sum(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums over all rows, matched with a place or not."""
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def level_buckets(rows: DataFrame, keys: list[str], level: str, value: str, levels: dict[str, list[str]]) -> DataFrame:
    """A sum for each level of classes; a class of no level is left out of all of them, and their total is beside them."""
    sums = [F.coalesce(F.sum(F.when(F.col(level).isin(v), F.col(value))), F.lit(0)).alias(k) for k, v in levels.items()]
    return rows.groupBy(*keys).agg(*sums, F.sum(value).alias("total"))


def year_panel(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left points with the right ones of the same key and year, where there are any."""
    return left.join(right, keys, "left")
