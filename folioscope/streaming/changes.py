"""Change feeds: arrival-order upserts from a file stream, and sessions by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.operators.relational import latest, upsert


def sessions(events: DataFrame, user: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events less than `gap` apart. On a stream, give `late`, how long to wait for late events."""
    rows = events.withWatermark(at, late) if late else events
    window = F.session_window(at, gap)
    return rows.groupBy(user, window).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), "n")


def read_feed(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[2:]) for n in found if n.startswith("v="))


def watch(feed: DataFrame, target: str, checkpoint: str, key: str, order: list[str]) -> None:
    """Apply all changes that have arrived to the table in `target`, then return; the last change of a key wins.

    Batch n writes version n from version n - 1, so a batch that is run again after a failure gives the same table. The
    version before the last stays until the next batch. Both folders must be shared by the cluster.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, order)
        before = [v for v in _versions(spark, target) if v < n]
        table = upsert(spark.read.parquet(f"{target}/v={before[-1]}"), new, key) if before else new
        table.write.mode("overwrite").parquet(f"{target}/v={n}")
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last batch."""
    return spark.read.parquet(f"{target}/v={_versions(spark, target)[-1]}")
