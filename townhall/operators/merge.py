"""Upserts without MERGE: a full outer join of the old rows and the last new row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What becomes of a column, given its old and its new value.
POLICIES = {
    "overwrite": lambda old, new, there: F.when(there, new).otherwise(old),
    "new_else_old": lambda old, new, there: F.coalesce(new, old),
    "old_else_new": lambda old, new, there: F.coalesce(old, new),
    "least": lambda old, new, there: F.least(old, new),
    "sticky_or": lambda old, new, there: F.coalesce(old | new, old, new),
    "keep": lambda old, new, there: old,
}


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order, which has to be total."""
    backwards = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(backwards)).filter("rn = 1").drop("rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], order: list[Column], version: str | None = None) -> DataFrame:
    """All keys of both sides with each column as its policy says, and `state`: kept, seen or new.

    version: a column of the policies; a row with a lesser one than the old row's came late and overwrites nothing.
    New rows of one key count once, the first by `order`. Merging the same rows again changes nothing.
    A null key equals a null key."""
    latest = last_of(new, keys, order).select(*(F.col(c).alias(f"new_{c}") for c in [*keys, *policies]), F.lit(True).alias("new_there"))
    before = old.select(*keys, *policies, F.lit(True).alias("old_there"))
    on = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
    both = before.join(latest, on, "full_outer")
    was, comes = F.col("old_there").isNotNull(), F.col("new_there").isNotNull()
    fresh = comes if version is None else comes & F.coalesce(F.col(f"new_{version}") >= F.col(version), F.lit(True))
    value = {c: F.when(was, POLICIES[p](F.col(c), F.col(f"new_{c}"), fresh)).otherwise(F.col(f"new_{c}")) for c, p in policies.items()}
    state = F.when(was & comes, "seen").when(comes, "new").otherwise("kept")
    return both.select(*(F.when(was, F.col(k)).otherwise(F.col(f"new_{k}")).alias(k) for k in keys), *(v.alias(c) for c, v in value.items()), state.alias("state"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def retire_missing(facts: DataFrame, subjects: DataFrame, source: str, key: str) -> DataFrame:
    """Without the facts of a source whose subject the source doesn't list any more; other sources' facts stay."""
    listed = subjects.select(F.col(key).alias("listed")).distinct().withColumn("there", F.lit(True))
    joined = facts.join(listed, F.col(key) == F.col("listed"), "left")
    return joined.filter((F.col("source") != source) | F.col("there")).drop("listed", "there")


def reconcile(listing: DataFrame, detail: DataFrame, key: str, value: str) -> DataFrame:
    """Listing and detail of each key: the detail wins, the listing's value is kept beside it, and confidence
    is 1.0 where they agree (nulls agree), 0.9 where they don't, or only one is there."""
    both = listing.select(key, F.col(value).alias("listed"), F.lit(True).alias("in_listing")).join(detail.select(key, F.col(value).alias("detailed"), F.lit(True).alias("in_detail")), key, "full_outer")
    agree = F.col("in_listing").isNotNull() & F.col("in_detail").isNotNull() & F.col("listed").eqNullSafe(F.col("detailed"))
    return both.select(key, F.coalesce("detailed", "listed").alias("value"), "listed", F.when(agree, 1.0).otherwise(0.9).alias("confidence"), (~agree).alias("audit"))


def fact_upsert(old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Facts (subject_id, fact_key, source, fact_value, retrieved_at, raw_confidence) after a load: one for each subject, key and source.

    A new value overwrites the old one, also by null; the confidence stays where the load has none; what the load
    doesn't name stays as it is. The load's rows of one identity count once, the first by `order`."""
    policies = {"fact_value": "overwrite", "retrieved_at": "overwrite", "raw_confidence": "new_else_old"}
    return upsert(old, new, ["subject_id", "fact_key", "source"], policies, order)


def import_tenures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tenures (tenure_id, office_id, person_id, start_date, end_date, status, source) after a new import: a tenure that is known
    takes the import's source, and keeps its person, status and end, which other jobs have set since."""
    policies = {"person_id": "keep", "start_date": "keep", "end_date": "keep", "status": "keep", "source": "overwrite"}
    return upsert(old, new, ["tenure_id", "office_id"], policies, [F.asc("source")])


def publish_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Writes a whole table as one version under root, and then points to it: a row in the log of versions.

    Readers take the last version of the log, so they see the table before or after the run, never a part of it. The
    log's row is written by one commit; a run that is repeated after a failure writes its version again."""
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/log")


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The table that the log points to."""
    version = spark.read.schema("version long").parquet(f"{root}/log").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")
