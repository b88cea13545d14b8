"""Looking at the row before, and summing the rows before, without gathering a whole group in one task.

A window partitioned by a key alone puts a key with a third of all rows into one task. Here the window runs inside (key, bucket), where the bucket
follows the order (a day, a block of ordinals), and only one row for each bucket takes part in the second window, which carries values across buckets. Where
there is no key at all, buckets of ordinals are themselves summed up in blocks, so a table of 10^12 rows leaves some 60,000 to the last window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b["_lamella_r_" + n]) for n in names])


def split_lag(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    """df with, under each new name in `values`, the given column's value in the row before within `keys` by `order`.

    The bucket must not decrease along the order. Rows that tie in the order follow each other arbitrarily, so the order should be unique. Null keys
    form one group; the first row of a group gets nulls; an empty table stays empty. All columns are kept; names that begin with _lamella are reserved.
    """
    d = df.withColumn("_lamella_bucket", bucket)
    near = Window.partitionBy(*keys, "_lamella_bucket").orderBy(*order)
    packed = F.struct(*[F.col(v).alias(n) for n, v in values.items()])
    d = d.withColumn("_lamella_near", F.lag(packed).over(near)).withColumn("_lamella_first", F.row_number().over(near) == 1)
    tails = df.withColumn("_lamella_bucket", bucket).groupBy(*keys, "_lamella_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_lamella_tail"))
    tails = tails.withColumn("_lamella_tail", F.lag("_lamella_tail").over(Window.partitionBy(*keys).orderBy("_lamella_bucket")))
    far = tails.select(*[F.col(n).alias("_lamella_r_" + n) for n in [*keys, "_lamella_bucket"]], "_lamella_tail")
    joined = d.join(far, _same(d, far, [*keys, "_lamella_bucket"]), "left")
    before = F.when(F.col("_lamella_first"), F.col("_lamella_tail")).otherwise(F.col("_lamella_near"))
    return joined.withColumn("_lamella_before", before).select(*[d[c] for c in df.columns], *[F.col("_lamella_before")[n].alias(n) for n in values])


def split_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str, bucket_blocks: int = 4096) -> DataFrame:
    """df with, as `name`, the sum of `value` over the rows before (0 for the first). Nulls count as 0; otherwise as split_lag.

    Without keys the bucket must be a whole number; so many buckets make a block.
    """
    d = df.withColumn("_lamella_bucket", bucket)
    worth = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    near = Window.partitionBy(*keys, "_lamella_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_lamella_near", F.coalesce(F.sum(worth).over(near), F.lit(0)))
    sums = df.withColumn("_lamella_bucket", bucket).groupBy(*keys, "_lamella_bucket").agg(F.sum(worth).alias("_lamella_sum"))
    if not keys and bucket_blocks:
        named = sums.withColumnRenamed("_lamella_bucket", "_lamella_at")
        far = split_sum(named, [], ["_lamella_at"], F.expr(f"_lamella_at div {bucket_blocks}"), "_lamella_sum", "_lamella_far", bucket_blocks=0).withColumnRenamed("_lamella_at", "_lamella_bucket")
    else:
        before = Window.partitionBy(*keys).orderBy("_lamella_bucket").rowsBetween(Window.unboundedPreceding, -1)
        far = sums.withColumn("_lamella_far", F.coalesce(F.sum("_lamella_sum").over(before), F.lit(0)))
    far = far.select(*[F.col(n).alias("_lamella_r_" + n) for n in [*keys, "_lamella_bucket"]], "_lamella_far")
    joined = d.join(far, _same(d, far, [*keys, "_lamella_bucket"]), "left")
    return joined.select(*[d[c] for c in df.columns], (F.col("_lamella_near") + F.coalesce(F.col("_lamella_far"), F.lit(0))).alias(name))
