"""Typed projection: a column as one exact kind, without widening; parts of nested values; presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.orc import FileError

#: The Spark type that holds each kind. BYTE is unsigned and therefore held in a smallint, or in a tinyint read from a file.
HELD: dict[str, tuple[type, ...]] = {
    "BOOLEAN": (T.BooleanType,), "BYTE": (T.ByteType, T.ShortType), "SHORT": (T.ShortType,), "INT": (T.IntegerType,), "LONG": (T.LongType,), "FLOAT": (T.FloatType,),
    "DOUBLE": (T.DoubleType,), "DECIMAL": (T.DecimalType,), "DATE": (T.DateType,), "TIMESTAMP": (T.TimestampNTZType, T.StructType), "STRING": (T.StringType,),
    "CHAR": (T.CharType, T.StringType), "VARCHAR": (T.VarcharType, T.StringType), "BINARY": (T.BinaryType,), "LIST": (T.ArrayType,), "MAP": (T.MapType, T.ArrayType), "STRUCT": (T.StructType,), "UNION": (T.StructType,),
}


def take(df: DataFrame, column: str, kind: str) -> Column:
    """The column, if it is of exactly this kind; raises FileError otherwise. BYTE comes out unsigned, DATE as its day number."""
    t = df.schema[column].dataType
    if kind not in HELD or not isinstance(t, HELD[kind]):
        raise FileError(f"{column} is {t.simpleString()}, not {kind}")
    if kind == "BYTE" and isinstance(t, T.ByteType):
        return df[column].cast("smallint").bitwiseAND(F.lit(255).cast("smallint"))
    if kind == "DATE":
        return F.unix_date(df[column])
    return df[column]


def try_take(df: DataFrame, column: str, kind: str) -> Column:
    """As take, with nulls in place of an error."""
    try:
        return take(df, column, kind)
    except FileError:
        return F.lit(None)


def struct_fields(df: DataFrame, column: str) -> list[Column]:
    """A struct's fields with their names."""
    take(df, column, "STRUCT")
    return [df[column][f.name].alias(f.name) for f in df.schema[column].dataType.fields]


def anonymous_fields(df: DataFrame, column: str) -> list[Column]:
    """A struct's values by position, whatever they are called: _0, _1, …"""
    take(df, column, "STRUCT")
    return [df[column][f.name].alias(f"_{i}") for i, f in enumerate(df.schema[column].dataType.fields)]


def union_variant(df: DataFrame, column: str, tag: int) -> Column:
    """The value of one variant of a union (struct of tag, v0, v1, …), null in rows of another."""
    variants = [f.name for f in df.schema[column].dataType.fields if f.name != "tag"]
    if not 0 <= tag < len(variants):
        raise FileError(f"{column} has no variant {tag}")
    return F.when(df[column]["tag"] == tag, df[column][variants[tag]])


def map_pairs(df: DataFrame, column: str) -> Column:
    """A map as a list of key and value, in order of its entries; lists of pairs stay, so null and repeated keys survive."""
    return F.map_entries(df[column]) if isinstance(df.schema[column].dataType, T.MapType) else take(df, column, "MAP")


def of_variant(df: DataFrame, column: str, tag: int) -> DataFrame:
    """The rows of one variant."""
    return df.where(F.col(column)["tag"] == tag)


def present(df: DataFrame, column: str) -> DataFrame:
    """The rows in which the column has a value."""
    return df.where(F.col(column).isNotNull())
