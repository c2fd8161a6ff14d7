"""Incremental ingestion of a folder of text files by Structured Streaming.

Each micro-batch is classified against the index table and folded into it, so that a file
that arrives twice, moves or changes is handled as in a batch run.  The index is a Parquet
folder per version; a batch that is run again finds its own version and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonewright.operators import index
from tonewright.sources import tree
from tonewright.sources.extract import format_of
from tonewright.sources.files import locale_of

INDEX = "sha256 string, entry_id string, origin string, aliases array<string>, kind string, locale string, status string, produced array<string>"


def read_index(spark: SparkSession, base: str, version: int) -> DataFrame:
    if version < 0:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{base}/v{version}")


def fold_batch(spark: SparkSession, files: DataFrame, base: str, version: int, locales: tuple[str, ...] = (), primary: str = "en") -> DataFrame:
    """The index after a batch of (origin, sha256): new hashes get an entry named by their
    hash, known hashes gain aliases, changed files replace their entry."""
    now = read_index(spark, base, version - 1)
    cls = index.classify(now, files)
    gone = cls.where("class = 'stale'").select("entry_id").distinct()
    kept = now.join(gone, "entry_id", "left_anti").select(*now.columns)
    none = F.array().cast("array<string>")
    folded = index.fold_aliases(files)
    new = folded.select("sha256", F.concat(F.lit("f"), F.substring("sha256", 1, 16)).alias("entry_id"), "origin", "aliases", F.lit("file").alias("kind"), locale_of(F.col("origin"), list(locales), primary).alias("locale"), F.lit("used").alias("status"), none.alias("produced"))
    return index.upsert(kept, new).select(*now.columns)


def start(spark: SparkSession, folder: str, base: str, checkpoint: str, glob: str = "*.txt", locales: tuple[str, ...] = (), primary: str = "en") -> StreamingQuery:
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    files = stream.select(F.col("path").alias("origin"), F.sha2("content", 256).alias("sha256"), format_of(F.col("path")).alias("format")).where("format is not null").select("origin", "sha256")

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fold_batch(session, batch, base, number, locales, primary).write.mode("overwrite").parquet(f"{base}/v{number}")
        # a batch that runs again needs the version before it, and no older one
        old = session._jvm.org.apache.hadoop.fs.Path(f"{base}/v{number - 2}")
        old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(workspace, folder: str, register_id: str, checkpoint: str, glob: str | None = None, name: str = "files") -> StreamingQuery:
    """A folder taken into the index of a workspace as its files arrive: each micro-batch goes
    through the batch ingestion (status, statistics, kept sums, entry numbers) and is one
    commit of the index's log, which remembers the batches of each stream by number, so that
    a batch run again after a restart changes nothing and other writers may work besides."""
    spark = workspace.spark
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    stream = (stream.option("pathGlobFilter", glob) if glob else stream).load(folder)
    root = tree.Tree(spark, folder).root
    arrived = stream.select(F.substr("path", F.lit(len(root) + 2)).alias("rel"), "content")

    def one(batch: DataFrame, number: int) -> None:
        workspace.take_in(batch, register_id, (name, number))

    return arrived.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
