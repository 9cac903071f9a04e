"""Quality rules: each gives violations (subject, rule, observed), none changes data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, subject: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each rule that a row breaks. rules: name to (what has to be true, what was observed); unknown is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), seen.cast("string").alias("observed"))) for n, (ok, seen) in rules.items())))
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(broken).alias("v")).select("subject", "v.*")


def provenance_rules(enums: dict[str, list[str]]) -> dict[str, tuple[Column, Column]]:
    """Source and time are there, enumerations hold, and a confidence, if any, is between 0 and 1."""
    rules = {"source": (F.col("source").isNotNull(), F.col("source")), "retrieved_at": (F.col("retrieved_at").isNotNull(), F.col("retrieved_at"))}
    rules |= {c: (F.col(c).isin(v), F.col(c)) for c, v in enums.items()}
    return rules | {"confidence": (F.col("confidence").isNull() | F.col("confidence").between(0, 1), F.col("confidence"))}


def universe_check(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Ids of first..last that are missing, stand there more than once, or lie outside."""
    counted = rows.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.count("*").alias("n"))
    expected = rows.sparkSession.range(first, last + 1).select("id", F.lit(True).alias("expected"))
    both = expected.join(counted, "id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "outside").when(F.col("n") > 1, "repeated")
    return both.select("id", problem.alias("problem")).filter("problem is not null")


def percent_check(rows: DataFrame, subject: str, part: str, total: str, published: str, tolerance: float = 0.1) -> DataFrame:
    """Rows whose published percentage differs from their own counts, or whose counts can't be."""
    share = F.try_divide(F.col(part) * 100.0, F.col(total))
    counts = (F.col(part) >= 0) & (F.col(part) <= F.col(total))
    return violations(rows, subject, {"counts": (counts, F.col(part)), "percent": (F.col(total).eqNullSafe(0) | (F.abs(share - F.col(published)) <= tolerance), F.round(share, 2))})


def drift_check(details: DataFrame, totals: DataFrame, key: str, value: str, total: str, tolerance: float = 0.01) -> DataFrame:
    """Keys whose summed details differ from the published total by more than the tolerance of it."""
    summed = details.groupBy(key).agg(F.sum(value).alias("summed"))
    drift = F.try_divide(F.abs(F.col("summed") - F.col(total)), F.abs(F.col(total)))
    return summed.join(totals.select(key, total), key).withColumn("drift", drift).filter(F.col("drift").isNull() | (F.col("drift") > tolerance))


def seed_check(rows: DataFrame, key: str, required: list[str], forbidden: str) -> DataFrame:
    """Repeated keys, empty required fields, and fields with a forbidden character."""
    rules = {f"{c} is empty": (F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in required}
    rules |= {f"{c} has a forbidden character": (~F.coalesce(F.contains(F.col(c).cast("string"), F.lit(forbidden)), F.lit(False)), F.col(c)) for c in required}
    repeated = rows.groupBy(F.col(key).cast("string").alias("subject")).agg(F.count("*").alias("n")).filter("n > 1")
    return violations(rows, key, rules).unionByName(repeated.select("subject", F.lit("repeated key").alias("rule"), F.col("n").cast("string").alias("observed")))


def markers_valid(summary: Column, n_sources: Column) -> Column:
    """At least one [k], and every k between 1 and the number of sources; a number too long for one is none of them."""
    found = F.regexp_extract_all(summary, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.coalesce((F.size(found) > 0) & F.forall(found, lambda k: F.coalesce(k.try_cast("int").between(1, n_sources), F.lit(False))), F.lit(False))


def notes_valid(sources: Column, noted: Column) -> Column:
    """Exactly one note for each source: the same numbers, none twice."""
    return (F.array_sort(sources) == F.array_sort(noted)) & (F.size(F.array_distinct(noted)) == F.size(noted))


def lock_category(communal: Column, sub_judice: Column, allegations: Column, before: Column) -> Column:
    """The first ground for a lock; a lock set before stays as it is."""
    return F.coalesce(before, F.when(communal, "communal").when(sub_judice, "sub_judice").when(allegations, "allegations"))


def publish_gate(drafts: DataFrame, verdicts: DataFrame, order: list[str]) -> DataFrame:
    """The outcome for each cluster of drafts (cluster_id, attempt, title) and verdicts (cluster_id, attempt, passes, lock_ground).

    The first attempt that passes publishes its title; without one the last attempt stands and nothing but a lock is
    written. A lock counts whichever attempt found it; of several grounds the first in `order`."""
    grounds = F.array(*map(F.lit, order))
    joined = drafts.join(verdicts, ["cluster_id", "attempt"], "left")
    passed = F.coalesce(F.col("passes"), F.lit(False))
    one = joined.groupBy("cluster_id").agg(
        F.min(F.when(passed, F.struct("attempt", "title"))).alias("good"), F.max("attempt").alias("last"),
        F.min(F.when(F.array_contains(grounds, F.col("lock_ground")), F.array_position(grounds, F.col("lock_ground")))).alias("lock"),
    )
    there = F.col("good").isNotNull()
    return one.select("cluster_id", F.when(there, F.col("good.attempt")).otherwise(F.col("last")).alias("attempt"), F.when(there, "publish").otherwise("withhold").alias("outcome"), F.when(there, F.col("good.title")).alias("title"), F.try_element_at(grounds, F.col("lock").cast("int")).alias("lock_category"))
