"""Feeds: eligibility, ranking, tiers, pools and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.functions.patterns import is_civic


def not_soft() -> Column:
    """Soft items go, items without a class stay."""
    return F.col("civic_class").isNull() | (F.col("civic_class") != "soft")


def in_language(lang: str) -> Column:
    """Items that can be shown in a language: with a clean title in it, or written in it."""
    return F.col(f"title_{lang}").isNotNull() | F.coalesce(F.col("lang") == lang, F.lit(False))


def of_tier(items: DataFrame, beyond: DataFrame, tier: str) -> DataFrame:
    """Items by the coverage of their outlet: "home" without the outlets beyond the region (outlet), "beyond" only those, "any" all.

    An item without an outlet is no item beyond. The registry of outlets is small, and joined as Spark sees fit."""
    if tier == "any":
        return items
    return items.join(beyond.select("outlet").distinct(), "outlet", {"home": "left_anti", "beyond": "left_semi"}[tier])


def by_composite_key(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """The places (level, code) that a list of keys (place, key: "level:code") names, in the list's order by `place`."""
    return places.join(wanted, F.concat_ws(":", "level", "code") == F.col("key")).orderBy("place")


def recent(column: str, as_of: str, days: int) -> Column:
    """Within the days before as_of; a null time is not recent."""
    return F.col(column) > F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))


def with_score(items: DataFrame, saved: list[str]) -> DataFrame:
    """items with score: 3 for high priority, else 2 for a civic subject without a priority, and 1.5 for a saved district."""
    low = items.withColumn("low", F.when(F.col("priority").isNull(), F.lower("headline")))  # only those texts are searched
    subject = F.when(F.col("priority") == "high", 3.0).when(F.col("priority").isNull() & is_civic(F.col("low")), 2.0).otherwise(0.0)
    return low.withColumn("score", subject + F.when(F.col("district").isin(saved), 1.5).otherwise(0.0)).drop("low")


def rank_order() -> list[Column]:
    """Score, then recency with unknown times as the oldest, then the id."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return [F.desc("score"), F.coalesce("published_at", epoch).desc(), F.asc("item_id")]


def civic_rank(items: DataFrame, saved: list[str], limit: int | None = None) -> DataFrame:
    ranked = with_score(items, saved).orderBy(*rank_order())
    return ranked.limit(limit) if limit else ranked


def top_per_key(items: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n of each key with their place; unknown times last, smaller ids first among equals."""
    order = Window.partitionBy(key).orderBy(F.col("published_at").desc_nulls_last(), F.asc("item_id"))
    return items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def feed_tiers(items: DataFrame, saved: list[str], first: int = 12, pool: int = 27) -> DataFrame:
    """The best `pool` items with their tier: top for the first ones, more for the rest."""
    best = civic_rank(items, saved, pool)  # a bounded top-k; the numbering below sees no more rows
    place = F.row_number().over(Window.orderBy(*rank_order()))
    return best.withColumn("place", place).withColumn("tier", F.when(F.col("place") <= first, "top").otherwise("more"))


def section_fill(clusters: DataFrame, items: DataFrame, key: str, slots: int = 5) -> DataFrame:
    """Items take the slots of each section that its clusters leave; those shown in a cluster aren't shown again."""
    taken = clusters.groupBy(key).agg(F.count_distinct("cluster_id").alias("n_clusters"))
    free = items.join(clusters.select("item_id").distinct(), "item_id", "left_anti").join(taken, key, "left")
    order = Window.partitionBy(key).orderBy(F.col("published_at").desc_nulls_last(), F.asc("item_id"))
    room = F.greatest(F.lit(0), F.lit(slots) - F.coalesce("n_clusters", F.lit(0)))
    return free.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= room)


def interleave(clusters: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Both kinds by time, the newest first; of equals clusters, then smaller ids."""
    both = clusters.select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("id"), "newest").unionByName(items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("published_at").alias("newest")))
    return both.orderBy(F.col("newest").desc_nulls_last(), "kind", "id").limit(limit)


def with_fallback(own: DataFrame, other: DataFrame, keys: DataFrame, key: str, page: int) -> DataFrame:
    """Each key's own rows; for keys without any, the other rows, flagged: a page of a feed, that many rows at most."""
    empty = keys.join(own.select(key).distinct(), key, "left_anti").select(key)
    rest = empty.crossJoin(F.broadcast(other.drop(key).limit(page)))
    return own.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


def daily_brief(clusters: DataFrame, limit: int = 5, unknown_first: bool = False) -> DataFrame:
    """Clusters by priority, outlets, and time; unknown_first: an unknown priority ranks before all others."""
    priority = F.col("priority").desc_nulls_first() if unknown_first else F.col("priority").desc_nulls_last()
    return clusters.orderBy(priority, F.desc("outlets"), F.col("newest").desc_nulls_last(), "cluster_id").limit(limit)


def capped(work: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of a work list, each with whether more are left."""
    first = work.orderBy(*order).limit(cap + 1)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    backlog = numbered.agg((F.count("*") > cap).alias("backlog"))
    return numbered.filter(F.col("place") <= cap).crossJoin(F.broadcast(backlog))


def sample_rows(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by the order of a hash of their key: random, and the same each time."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)
