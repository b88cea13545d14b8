"""How columns would encode: runs, dictionaries, deltas and packed bits as relations, for inspection.

Everything works on chunks (a stripe's rows), which bound every window. Columns: chunk, ordinal (within the table or the chunk), and the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A string column is written with a dictionary if fewer than this share of its present values are distinct.
DICTIONARY_SHARE = 0.5
#: Greatest length of a run: a fixed value of the format.
RUN_MOST = 130


def dictionary_decision(df: DataFrame, value: str) -> DataFrame:
    """chunk, present, distinct, dictionary: whether a dictionary pays. The counts are partial aggregates, so no chunk is gathered."""
    out = df.groupBy("chunk").agg(F.count(value).alias("present"), F.count_distinct(value).alias("distinct"))
    return out.withColumn("dictionary", F.col("distinct") < F.col("present") * DICTIONARY_SHARE)


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """chunk, id, value: the distinct present values in order of their first appearance."""
    first = df.where(F.col(value).isNotNull()).groupBy("chunk", F.col(value).alias("value")).agg(F.min("ordinal").alias("_first"))
    return first.select("chunk", (F.row_number().over(Window.partitionBy("chunk").orderBy("_first")) - 1).cast("bigint").alias("id"), "value")


def dictionary_encode(df: DataFrame, value: str) -> DataFrame:
    """chunk, ordinal, id: null values have a null id."""
    d = dictionary(df, value).withColumnRenamed("value", "_value")
    rows = df.select(F.col("chunk").alias("_chunk"), "ordinal", F.col(value).alias("_own"))
    joined = rows.join(d, (rows["_chunk"].eqNullSafe(d["chunk"])) & (rows["_own"] == d["_value"]), "left")
    return joined.select(F.col("_chunk").alias("chunk"), "ordinal", "id")


def dictionary_decode(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """The inverse: chunk, ordinal, value."""
    return ids.join(entries, ["chunk", "id"], "left").select("chunk", "ordinal", "value")


def tag_counts(df: DataFrame, tag: str) -> DataFrame:
    """chunk, tag, n: rows of each variant."""
    return df.where(F.col(tag).isNotNull()).groupBy("chunk", F.col(tag).alias("tag")).agg(F.count("*").alias("n"))


def equal_runs(df: DataFrame, value: str) -> DataFrame:
    """chunk, start, length, value: stretches of one value, nulls included, by gaps and islands."""
    w = Window.partitionBy("chunk").orderBy("ordinal")
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    marked = df.select("chunk", "ordinal", F.col(value).alias("value"), changed.cast("int").alias("_new"))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy("chunk", "_run").agg(F.min("ordinal").alias("start"), F.count("*").alias("length"), F.first("value").alias("value")).drop("_run")


def step_runs(df: DataFrame, value: str) -> DataFrame:
    """chunk, start, length, base, step: stretches in which each value is the one before plus a constant, greedily from each chunk's first value.

    A value whose step differs from the one before it begins no run of its own unless the next step differs again: it ends the stretch before. So
    stretches are the islands of equal steps; `base` is the value before the first step, and lone values have a null step. Whole values are compared.
    """
    w = Window.partitionBy("chunk").orderBy("ordinal")
    d = df.select("chunk", "ordinal", F.col(value).cast("bigint").alias("_v"))
    d = d.withColumn("_step", F.col("_v") - F.lag("_v").over(w)).withColumn("_place", F.row_number().over(w))
    new = F.when(F.col("_place") <= 2, 1).when(F.col("_step") == F.lag("_step").over(w), 0).otherwise(1)
    d = d.where("_place >= 1").withColumn("_run", F.sum(F.when(F.col("_place") == 1, 0).otherwise(new)).over(w))
    runs = d.groupBy("chunk", "_run").agg(F.min("ordinal").alias("start"), F.count("*").alias("length"), F.min_by(F.col("_v") - F.coalesce("_step", F.lit(0)), "ordinal").alias("base"), F.max("_step").alias("step"))
    return runs.where("_run > 0").select("chunk", (F.col("start") - 1).alias("start"), (F.col("length") + 1).alias("length"), "base", "step")


def expand_runs(runs: DataFrame, key: str, length: str, base: str, step: str) -> DataFrame:
    """Runs as values: (key, i, value) = base + i * step for 0 <= i < length. Runs without a length give nothing."""
    places = F.explode(F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1)))
    return runs.select(key, F.col(base).alias("_b"), F.col(step).alias("_s"), places.alias("i")).select(key, "i", (F.col("_b") + F.col("i") * F.col("_s")).alias("value"))


def short_repeat(value: Column, count: Column) -> Column:
    """A value repeated 3 to 10 times, as a list; other counts give null."""
    return F.when(count.between(3, 10), F.array_repeat(value, count))


def pack_bits(df: DataFrame, bit: str) -> DataFrame:
    """chunk, byte_no, byte (0..255): eight booleans to a byte in order of ordinal, the first in the highest bit. Null counts as false."""
    w = Window.partitionBy("chunk").orderBy("ordinal")
    placed = df.select("chunk", (F.row_number().over(w) - 1).alias("_i"), F.coalesce(F.col(bit), F.lit(False)).cast("int").alias("_b"))
    shifted = F.expr("shiftleft(_b, 7 - _i % 8)")
    return placed.groupBy("chunk", F.expr("_i div 8").alias("byte_no")).agg(F.sum(shifted).cast("int").alias("byte"))


def unpack_bits(packed: DataFrame) -> DataFrame:
    """The inverse, in whole bytes: chunk, place, bit."""
    places = F.explode(F.sequence(F.lit(0), F.lit(7)))
    return packed.select("chunk", "byte_no", "byte", places.alias("_j")).select("chunk", (F.col("byte_no") * 8 + F.col("_j")).cast("bigint").alias("place"), (F.expr("shiftright(byte, 7 - _j) & 1") == 1).alias("bit"))


def deltas(df: DataFrame, value: str) -> DataFrame:
    """chunk, ordinal, base, delta: the chunk's first value, and each value less the one before (0 for the first)."""
    w = Window.partitionBy("chunk").orderBy("ordinal")
    v = F.col(value).cast("bigint")
    return df.select("chunk", "ordinal", F.first(v).over(w).alias("base"), F.coalesce(v - F.lag(v).over(w), F.lit(0)).alias("delta"))


def undo_deltas(df: DataFrame) -> DataFrame:
    """The inverse: chunk, ordinal, value."""
    w = Window.partitionBy("chunk").orderBy("ordinal")
    return df.select("chunk", "ordinal", (F.col("base") + F.sum("delta").over(w)).alias("value"))


def varint_length(value: Column, signed: bool = True) -> Column:
    """The bytes that a number takes in base 128: seven bits to a byte."""
    from lamella.functions.bits import zigzag

    code = zigzag(value, signed)
    bits = F.length(F.regexp_replace(F.bin(code), "^0+", ""))
    return F.greatest(F.lit(1), F.ceil(bits / 7)).cast("int")
