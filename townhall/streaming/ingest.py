"""The ingest and pairing jobs as Structured Streaming over files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from townhall.operators.graph import folder_for
from townhall.operators.merge import upsert


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def land_slices(rows: DataFrame, at: str, path: str, slices: int, files: int | None = None) -> float:
    """Writes rows as files under path, by slices of time one after the other, and returns the hours of a slice.

    A file source takes files by their times of writing, and those of one slice in any order. So rows come at most a
    slice's hours late, which is the least watermark with which nothing is dropped. files: of a slice; if none, as many as
    rows has partitions, and so has a stream that takes files by number as many more batches."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    rows.limit(0).write.mode("append").parquet(path)  # the folder is there, whatever comes
    if low is None:
        return 0.0
    width = (high - low) / slices
    for i in range(slices):
        part = rows.filter((F.col(at) >= F.lit(low + i * width)) & (F.lit(i == slices - 1) | (F.col(at) < F.lit(low + (i + 1) * width))))
        (part.repartition(files) if files else part).write.mode("append").parquet(path)
    return width.total_seconds() / 3600


#: Parts that a state of keys is kept in.
BUCKETS = 32


class KeyedState:
    """A table of states under a folder, in parts by the hash of the key, and a log of which version holds each part.

    A batch reads and writes the parts that its keys fall into. The log's row of a batch is written after its parts, so a
    batch that runs again reads what the batch before it left and writes its own version again."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.log: list[tuple[int, int]] | None = None  # part and version, read once: a row for each part of a batch

    def part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def versions(self, before: int) -> dict[int, int]:
        """Which batch wrote each part last, of those before a batch."""
        if self.log is None:
            try:
                self.log = [tuple(r) for r in self.spark.read.schema("part int, version long").parquet(f"{self.path}/log").distinct().collect()]
            except AnalysisException:  # nothing was written yet
                self.log = []
        return dict(sorted((x for x in self.log if x[1] < before), key=lambda x: x[1]))

    def read(self, parts: list[int] | None = None, before: int = 1 << 62) -> DataFrame:
        known = self.versions(before)
        paths = [f"{self.path}/v{v}/part={p}" for p, v in sorted(known.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, step) -> None:
        """step(old, new) gives the state of the keys of the parts that a batch falls into."""
        rows = self.part(batch).persist()
        parts = [r["part"] for r in rows.select("part").distinct().collect()]  # as many as there are parts, at most
        if parts:
            after = self.part(step(self.read(parts, number), rows.drop("part")))
            after.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{number}")
            old = self.versions(number - 1)
            self.spark.createDataFrame([(p, number) for p in parts], "part int, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
            self.log += [(p, number) for p in parts]
            self.forget(old, self.versions(number))
        rows.unpersist()

    def forget(self, old: dict[int, int], known: dict[int, int]) -> None:
        """Removes the parts of old that the batch before this one has written again: no batch reads them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for part, version in old.items():
            if known[part] != version:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}/part={part}")
                path.getFileSystem(conf).delete(path, True)


def upsert_stream(stream: DataFrame, state: KeyedState, policies: dict[str, str], order: list[Column], checkpoint: str, version: str | None = None, prepared=None) -> StreamingQuery:
    """Merges each micro-batch into a keyed state, as upsert() does."""

    def step(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert(old, prepared(new) if prepared else new, state.keys, policies, order, version).drop("state")

    return stream.writeStream.foreachBatch(lambda batch, number: state.merge(batch, number, step)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metered(stream: DataFrame, name: str, errors: Column) -> DataFrame:
    """The stream with health metrics of each micro-batch under a name: rows, and those with an error."""
    return stream.observe(name, F.count(F.lit(1)).alias("n_items"), F.count(F.when(errors, 1)).alias("n_errors"))


def batch_metrics(progress: DataFrame, name: str) -> DataFrame:
    """batch, n_items, n_errors of the micro-batches of a table of progress (health.ProgressTable) that report under a name."""
    of = F.from_json(F.get_json_object("metrics", f"$.{name}"), "n_items long, n_errors long")
    return progress.select("batch", of.alias("m")).filter("m is not null").select("batch", "m.n_items", "m.n_errors")


def deduped(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def pair_stream(left: DataFrame, right: DataFrame, hours: int, late: str) -> DataFrame:
    """id_a < id_b, token of the rows of two streams (id, at, token) with one token less than so many hours apart.

    Both sides have a watermark, so state older than the interval is dropped."""
    a = left.withWatermark("at", late).select(F.col("id").alias("id_a"), F.col("at").alias("at_a"), F.col("token").alias("token"))
    b = right.withWatermark("at", late).select(F.col("id").alias("id_b"), F.col("at").alias("at_b"), F.col("token").alias("token_b"))
    on = F.expr(f"token = token_b and id_a < id_b and at_b > at_a - interval {hours} hours and at_b < at_a + interval {hours} hours")
    return a.join(b, on).select("id_a", "id_b", "token")


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Rows of each window and key, final once the watermark has passed the window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    out = folder_for(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
