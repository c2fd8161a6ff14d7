"""What several operators share: scratch tables, connected components, text digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where that is unset a temporary folder
    is set on a local master (tests), and it is an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read back: lineage ends there, a lost
    executor costs no recomputation, and later joins know its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def conf_set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs."""
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Deletes a table made by `stored` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: `edges` (a, b) to (node, root), root the smallest node of the
    component.  Nodes without an edge do not occur; no edges give no rows.

    Each round every node takes the least of its own, its neighbours' and its root's
    label, and each root the least label seen by its tree (hooking), so long chains halve.
    Edges are joined by node and labels are minima with map-side combining; no group is
    collected.  The join of labels on themselves meets a hot root only on the side that
    adaptive execution can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        parent = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = stored(labels.join(parent, "root", "left").select("node", "root", F.coalesce("up", "root").alias("up")), "jumped")
        seen = both.join(jumped.select(F.col("node").alias("b"), F.col("up").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        best = jumped.join(seen, "node").select("node", "root", F.least("up", "seen").alias("best"))
        hooks = best.groupBy(F.col("root").alias("hooked")).agg(F.min("best").alias("hook"))
        after = best.join(hooks, F.col("node") == F.col("hooked"), "left").withColumn("least", F.least("best", F.coalesce("hook", "best")))
        after = stored(after.select("node", F.col("least").alias("root"), (F.col("least") < F.col("root")).alias("moved")), "labels")
        discard(jumped)
        done = not after.where("moved").limit(1).count()
        discard(labels)
        labels = after
        if done:
            break
    discard(both)
    return labels.select("node", "root")
