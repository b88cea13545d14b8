"""Whole tables as values: length, appending under a strict check, concatenation, and empty tables of a type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.orc import FileError


def length(df: DataFrame) -> DataFrame:
    """One row: n, the number of rows. A table without columns has none."""
    return df.agg(F.count(F.lit(1)).alias("n")) if df.columns else df.sparkSession.createDataFrame([(0,)], "n bigint")


def shape(t: T.DataType) -> str:
    """A type with its field names in order and without nullability."""
    if isinstance(t, T.StructType):
        return "{" + ",".join(f"{f.name}:{shape(f.dataType)}" for f in t.fields) + "}"
    if isinstance(t, T.ArrayType):
        return f"[{shape(t.elementType)}]"
    if isinstance(t, T.MapType):
        return f"({shape(t.keyType)},{shape(t.valueType)})"
    return t.simpleString()


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, repeats included. Raises FileError unless types, names and their order agree at every depth; nullability needn't."""
    if shape(a.schema) != shape(b.schema):
        names = [f.name for f in a.schema] != [f.name for f in b.schema]
        raise FileError(f"mismatched {'column names' if names else 'columns'}: {shape(a.schema)} and {shape(b.schema)}")
    return a.union(b)


def empty_of(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A table of a type without rows."""
    return spark.createDataFrame([], schema)


def concat(spark: SparkSession, schema: T.StructType | str, tables: list[DataFrame]) -> DataFrame:
    """All tables one after the other, each checked as by append; the empty table of the type where there are none."""
    return reduce(append, tables) if tables else empty_of(spark, schema)
