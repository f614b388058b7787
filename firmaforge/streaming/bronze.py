"""Incremental loading as streams over folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from firmaforge.sources.raw import high_water_mark, latest_per_key, newer_than
from firmaforge.session import cut, discard, new_shared_path


def read_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", name: str | None = None, per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.load(folder)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First row of each key; state is kept for ``delay`` and so stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def day_counts(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows per calendar day."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"))
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("day"), "count")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table, exactly once, everything available now."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class KeyedTable:
    """A Parquet table of one row per key, partitioned by a hash of the key.

    A batch reads the partitions that its keys fall into, stages the merged rows, and overwrites
    those partitions alone (Spark's dynamic partition overwrite). The latest row of a key wins,
    so a batch that is repeated after a failure leaves the same rows. Readers should not run
    while a batch is being written: partitions are replaced one by one.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = 64):
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        empty = spark.createDataFrame([], self.schema).withColumn("_bucket", self._bucket())
        empty.write.mode("ignore").partitionBy("_bucket").parquet(path)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def merge(self, incoming: DataFrame, order: list[str]) -> None:
        """Keep the latest row per key; an older row that arrives late changes nothing."""
        fresh = cut(latest_per_key(incoming.select(*self.schema.names), self.keys, order))
        # The buckets of the batch: no more than the table has.
        touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]
        stored = self._stored().filter(F.col("_bucket").isin(touched)).drop("_bucket")
        merged = latest_per_key(stored.unionByName(fresh), self.keys, order)
        staged = cut(merged.withColumn("_bucket", self._bucket()))
        staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "_bucket"
        ).parquet(self.path)
        discard(fresh, staged)

    def read(self) -> DataFrame:
        return self._stored().drop("_bucket")


def upsert_latest(stream: DataFrame, table: KeyedTable, order: list[str], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into the table."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: table.merge(batch, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_increment(table: KeyedTable, raw: DataFrame, ts: str, order: list[str] | None = None, overlap: str | None = None) -> None:
    """One batch load of what arrived since the last one; rewrites touched partitions only."""
    table.merge(newer_than(raw, high_water_mark(table.read(), ts), ts, overlap), order or [ts])


def complete_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a small result table (bounded by its keys) after every micro-batch.

    Each batch has a folder of its own, so a reader never meets a table that is half written;
    :func:`latest` reads the last one.
    """
    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{n:010d}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, last_batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{last_batch:010d}")


def run(query: StreamingQuery) -> int:
    """Wait for the stream to work off what is there; number of the last batch."""
    query.awaitTermination()
    progress = query.lastProgress
    return int(progress["batchId"]) if progress else -1


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output and checkpoint path in the shared folder."""
    base = new_shared_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
