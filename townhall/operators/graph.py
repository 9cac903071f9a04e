"""Components of a graph of links, in rounds over tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share (spark.checkpoint.dir).

    Where nothing is set, a local folder serves a local master, as in tests; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, to cut its lineage."""
    path = folder_for(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes the folders of written tables that nothing reads any more: a round's, once the next one's is written."""
    for df in tables:
        path = getattr(df, "folder", None)
        if path:
            jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)


def least_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node that each node reaches over links (a, b).

    Each round takes the least label among the neighbours and then the label of that label, so a chain
    is halved each time; it ends when no label changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "l").alias("new"), "label")
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("jumped"))
        after = written(step.join(jump, F.col("new") == F.col("at"), "left").select("node", F.least("new", "jumped").alias("new"), "label"), "labels")
        changed = after.filter("new <> label").limit(1).count()
        forget(labels)
        labels = after.select("node", F.col("new").alias("label"))
        labels.folder = after.folder
        if not changed:
            forget(both)
            return labels
