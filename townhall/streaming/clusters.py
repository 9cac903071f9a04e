"""Clusters of events as a stream: their state lives on from run to run, and items end after seven days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from townhall.operators.events import HOURS, advance_clusters, candidate_pairs

DAYS = 7
STATE = "item_id long, published_at timestamp_ntz, persons array<string>, districts array<string>, strings array<string>, cluster_id long"


class ClusterState:
    """Tables under a folder: the live items with their clusters, a version for each batch, and what has ended.

    A batch reads the version before its own and writes its own and what it ends, each under its number, before the
    checkpoint knows of it; a batch that runs again after a failure does the same again. The version before the one before
    is removed, so a state is as large as what was published within the days, twice."""

    def __init__(self, spark: SparkSession, path: str, days: int = DAYS, hours: int = HOURS):
        self.spark, self.path, self.days, self.hours = spark, path.rstrip("/"), days, hours

    def _read(self, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(STATE).parquet(path)
        except AnalysisException:  # nothing was written there
            return self.spark.createDataFrame([], STATE)

    def _fs(self, path: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm

    def versions(self) -> list[int]:
        """The numbers of the batches whose state is there, whole."""
        fs, top = self._fs(f"{self.path}/live")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[1:]) for n in names if fs.exists(self._fs(f"{self.path}/live/{n}/_SUCCESS")[1]))

    def live(self, before: int = 1 << 62) -> DataFrame:
        known = [v for v in self.versions() if v < before]
        return self._read(f"{self.path}/live/v{known[-1]}") if known else self.spark.createDataFrame([], STATE)

    def ended(self) -> DataFrame:
        """Items whose days are over, with the cluster they ended in (or null)."""
        return self._read(f"{self.path}/ended/*")

    def clusters(self) -> DataFrame:
        """item_id, cluster_id of all items that came, live ones and those that have ended."""
        return self.ended().unionByName(self.live()).groupBy("item_id").agg(F.max("cluster_id").alias("cluster_id"))  # an item sent again after its end

    def advance(self, batch: DataFrame, number: int, judge: Callable[[DataFrame, DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame]) -> None:
        """One batch of signatures (item_id, published_at, persons, districts, strings).

        Time is the latest publication of all that came. Items published so many days before it, or earlier, take no part
        any more: live ones end with the cluster they have, and late ones without any. The rest goes as advance_clusters
        says; items that are live already, and repeated rows, are taken once. judge(new, members) says which pairs
        (item_id, cluster_id, same) are one event, confirm(pairs) which of the pairs of items are."""
        old = self.live(number)
        new = batch.select(*[c.split()[0] for c in STATE.split(", ")[:-1]]).filter("published_at is not null").dropDuplicates(["item_id"])
        new = new.join(old.select("item_id"), "item_id", "left_anti").persist()
        latest = old.select("published_at").unionByName(new.select("published_at")).agg(F.max("published_at").alias("at")).first()["at"]
        if latest is not None:
            since = F.lit(latest).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(self.days))
            stays = F.col("published_at") > since
            members = old.filter(stays & F.col("cluster_id").isNotNull())
            fresh = new.filter(stays)
            pool = fresh.unionByName(old.filter(stays & F.col("cluster_id").isNull()).drop("cluster_id"))
            pairs = confirm(candidate_pairs(pool, self.hours))
            after = advance_clusters(old.filter(stays), fresh, judge(fresh, members), pairs, since)
            over = old.filter(~stays).unionByName(new.filter(~stays).withColumn("cluster_id", F.lit(None).cast("long")))
            over.write.mode("overwrite").parquet(f"{self.path}/ended/v{number}")
            after.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/live/v{number}")
            for v in self.versions()[:-2]:
                fs, at = self._fs(f"{self.path}/live/v{v}")
                fs.delete(at, True)
        new.unpersist()


def cluster_stream(signed: DataFrame, state: ClusterState, judge, confirm, checkpoint: str) -> StreamingQuery:
    """Advances a state of clusters by each micro-batch of a stream of signatures, until all that is there has come."""
    step = lambda batch, number: state.advance(batch, number, judge, confirm)
    return signed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
