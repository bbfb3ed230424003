"""Joins that survive a key with a large share of all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key beyond which the key is spread over several tasks.
HOT_ROWS = 1_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: Column, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has one row a key and in column n how many rows of left have that key.

    A key with more than hot_rows rows is cut into n / hot_rows parts: left picks the part by spread, right is copied to
    each. At most (rows of left / hot_rows) keys are that hot, so their table is small by construction and broadcast.
    Null keys match nothing."""
    hot = right.where(F.col(n) > hot_rows).select(*keys, F.ceil(F.col(n) / hot_rows).cast("int").alias("_parts"))
    left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    )
    right = right.withColumn("_part", F.explode(F.when(F.col(n) > hot_rows, F.sequence(F.lit(0), F.ceil(F.col(n) / hot_rows).cast("int") - 1)).otherwise(F.array(F.lit(0)))))
    return left.drop("_parts").join(right, [*keys, "_part"], how).drop("_part")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has one row a key, when it isn't known how often left has the keys: they are counted
    first (partial aggregation), and hot ones are spread."""
    n = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    return salted_join(left, right.join(n, keys), keys, "_n", spread, how, hot_rows).drop("_n")
