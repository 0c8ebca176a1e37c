"""The scan as a stream.

Files arrive by a file source, pass narrow transformations, and micro-batches are merged into a catalog table.
Watermarks are an addition of this engine: what it models has no notion of late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from cairnlake.sources.catalog import kind_of
from cairnlake.sources.ingest import upsert, with_presence

WATERMARK = "1 hour"


def discovered(spark: SparkSession, folder: str, glob: str = "*", max_files: int = 256) -> DataFrame:
    """Files below a folder as they appear, without their content; batches hold max_files at most."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(max_files)).load(folder)
    )
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), extension.alias("extension"), kind_of(extension).alias("kind"))


def events(spark: SparkSession, folder: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files)).parquet(folder)


def merge_into(stream: DataFrame, table_path: str, checkpoint: str, key: str, keep_old_when_null: list[str], every: str | None = None) -> StreamingQuery:
    """Micro-batches merged into a Parquet table by key.

    A batch writes a new version beside the old one and then points to it, so a batch that is repeated after a
    failure, or read while it runs, sees a whole version. Within a batch the last row of a key by `modified`
    wins. Without `every` the query handles what is there and stops.
    """
    spark = stream.sparkSession
    pointer = f"{table_path}/_current"

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "modified").alias("r")).select("r.*")
        old = current(spark, table_path)
        new = upsert(old, with_presence(rows), key, keep_old_when_null) if old is not None else rows
        version = f"{table_path}/version={number}"
        new.write.mode("overwrite").parquet(version)
        spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").text(pointer)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The last whole version of a merged table, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_path}/_current")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(spark.read.text(f"{table_path}/_current").first()[0])


def first_owners(stream: DataFrame, key: str = "content_hash", time: str = "modified") -> DataFrame:
    """Of files with equal content the first to come within the watermark; others reuse its results."""
    return stream.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    """Gap sessions with their counts."""
    return stream.withWatermark(time, WATERMARK).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(stream: DataFrame, time: str, length: str, stride: str) -> DataFrame:
    """Counts over tumbling or sliding windows."""
    return stream.withWatermark(time, WATERMARK).groupBy(F.window(time, length, stride).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def change_log(old: DataFrame, new: DataFrame, key: str, generation: int) -> DataFrame:
    """(key, change, generation): rows added, changed or removed between two versions."""
    a = old.select(key, F.xxhash64(*[c for c in old.columns if c != key]).alias("__a"))
    b = new.select(key, F.xxhash64(*[c for c in old.columns if c != key]).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), F.lit(generation).cast("long").alias("generation")).where("change IS NOT NULL")


def trimmed_log(log: DataFrame, keep: int = 100_000) -> DataFrame:
    """The newest entries of a change log, whole generations until `keep` entries are reached."""
    each = log.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))  # a row for each generation
    sizes = sorted(((r.generation, r.n) for r in each.collect()), reverse=True)
    held, first = 0, None
    for generation, n in sizes:
        if first is not None and held + n > keep:
            break
        held, first = held + n, generation
    return log.where(F.col("generation") >= first) if first is not None else log


class Progress(StreamingQueryListener):
    """Rows and batches of running queries, for callers that show progress."""

    def __init__(self) -> None:
        self.rows, self.batches, self.ended = 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
