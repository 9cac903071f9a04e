"""Health of streams: a listener that keeps every progress of every query in a table."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: One row for each progress; metrics are those that the query observes, as JSON by their names.
SCHEMA = "run string, query string, batch long, at string, n_input long, seconds double, metrics string"


class ProgressTable(StreamingQueryListener):
    """Writes each progress as one small file under a folder, named by run and batch: a table of as many rows as batches.

    A query keeps the last hundred of its reports only; this keeps all, also of a run that fails later. A batch that is
    reported again (an idle trigger, or a restart from the checkpoint) replaces its own row. Start it before the queries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ended: set[str] = set()
        self.changed = threading.Condition()
        self.failure: Exception | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        seconds = (p.get("durationMs") or {}).get("triggerExecution", 0) / 1000
        row = {"run": p["runId"], "query": p.get("name"), "batch": p["batchId"], "at": p["timestamp"], "n_input": p.get("numInputRows", 0), "seconds": seconds, "metrics": json.dumps(p.get("observedMetrics") or {})}
        try:
            self._put(f"{p['runId']}-{p['batchId']}.json", json.dumps(row))
        except Exception as e:  # noqa: BLE001 - an exception here would only be logged; rows() raises it
            self.failure = e

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def _put(self, name: str, text: str) -> None:
        """A file of one line in whatever file system the folder is in, whole or not at all."""
        jvm = self.spark._jvm
        fs_path = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        fs = fs_path(name).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(fs_path("_pending"))
        out = fs.create(fs_path(f"_pending/{name}"), True)
        out.write(bytearray((text + "\n").encode()))
        out.close()
        fs.delete(fs_path(name), False)
        fs.rename(fs_path(f"_pending/{name}"), fs_path(name))

    def wait(self, run: str, seconds: float = 60) -> None:
        """Waits until the last report of a run that has ended is here: reports come after it, one by one."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(run) in self.ended, seconds):
                raise TimeoutError(f"run {run} has not reported its end")
        if self.failure:
            raise self.failure

    def rows(self) -> DataFrame:
        """The table so far; empty before the first report."""
        self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
        return self.spark.read.schema(SCHEMA).json(self.path)


def recorded(spark: SparkSession, path: str, start) -> DataFrame:
    """Runs a query, which start() starts, to its end, and returns the table of its progress under path."""
    table = ProgressTable(spark, path)
    spark.streams.addListener(table)
    try:
        query = start()
        query.awaitTermination()
        table.wait(query.runId)
    finally:
        spark.streams.removeListener(table)
    return table.rows()
