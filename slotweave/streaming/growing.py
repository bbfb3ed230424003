"""Structured Streaming: option types that grow batch by batch, and windowed counts of late data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotweave.functions import text as X
from slotweave.session import finished


def updated_types(types: DataFrame | None, options: DataFrame, most: int = 8, short: int = 50) -> DataFrame:
    """(name, n, examples): the types after a batch of options: each slot's distinct values of at most `short` tokens, the
    first `most` kept as examples, in order of arrival. Blank slots count for '_uncategorized'."""
    o = options.where(~X.blank("value") & (F.coalesce("token_length", F.lit(0)) <= short)).withColumn("name", F.when(X.blank("slot"), "_uncategorized").otherwise(F.lower(F.trim("slot"))))
    distinct = o.groupBy("name", "value").agg(F.min("option_seq").alias("s"), F.count("*").alias("k"))
    from pyspark.sql import Window as W

    first = distinct.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("s"))).where(F.col("r") <= most)
    new = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "value"))), lambda x: x["value"]).alias("e")).join(distinct.groupBy("name").agg(F.sum("k").alias("k")), "name")
    if types is None:
        return new.select("name", F.col("k").alias("n"), F.col("e").alias("examples"))
    none = F.array().cast("array<string>")
    return types.join(new, "name", "full_outer").select(
        "name", (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n"), F.slice(F.array_union(F.coalesce("examples", none), F.coalesce("e", none)), 1, most).alias("examples")
    )


class TypeTable:
    """The types as a table with one folder a batch; batches are applied once each, in order (foreachBatch). The newest
    folder that was written to its end counts, so a new object on the same path goes on where the last one ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.batch = max(finished(spark, path), default=-1)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{self.batch}") if self.batch >= 0 else None

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.batch:
            return
        updated_types(self.read(), batch).write.mode("overwrite").parquet(f"{self.path}/{number}")
        self.batch = number


def grow_types(stream: DataFrame, table: TypeTable, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; rows later than `late` behind the newest are no longer counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
