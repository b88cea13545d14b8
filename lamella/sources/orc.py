"""Reading, writing and re-encoding ORC files through Spark's own reader and writer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.jsontext import json_rows

#: Codecs that can be asked for, and what Spark calls them. Without one, files are not compressed.
CODECS = {"none": "uncompressed", "snappy": "snappy", "zlib": "zlib", "zstd": "zstd"}
#: Bytes in a compression block, and rows in a stripe, unless asked otherwise.
BLOCK, STRIPE_ROWS = 262_144, 10_000


class FileError(Exception):
    """The one error that reading and writing raise for bad input."""


def codec(name: str | None) -> str:
    """The writer option of a codec name; an unknown name raises ValueError. None means no compression."""
    if name is None:
        return CODECS["none"]
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}; known: {', '.join(CODECS)}")
    return CODECS[name]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file or folder; filters and columns reach the reader. An empty file keeps its schema."""
    return spark.read.orc(path)


def with_file(spark: SparkSession, path: str, then: Callable[[T.StructType, DataFrame], object]):
    """Opens a file and gives its schema and rows to `then`, raising FileError on a bad one."""
    try:
        df = scan(spark, path)
        schema = df.schema
    except Exception as e:
        raise FileError(f"{path}: {e}") from e
    return then(schema, df)


@dataclass
class Result:
    """Either a value or an error."""

    value: object = None
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def attempt(action: Callable[[], object]) -> Result:
    """Runs an action and gives its value or its error as a value."""
    try:
        return Result(action())
    except Exception as e:
        return Result(error=e)


def check_schema(df: DataFrame, expected: T.StructType | None) -> None:
    """Raises FileError unless df has the expected names and types in order. Nullability is no part of a schema here."""
    if expected is None:
        return
    bare = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    if bare(df.schema) != bare(expected):
        raise FileError(f"expected {expected.simpleString()}, got {df.schema.simpleString()}")


def checked_rows(rows: DataFrame, text: str, expected: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of rows of JSON text under a schema: the rows whose every value is of its field's kind, and of the others their text with `error`.

    Kinds are checked strictly: a number with a fraction, or one beyond a field's range, is no integer, and a string is no number. A null row is a fault;
    a field that is absent is null; a member that the schema doesn't name is a fault as well.
    """
    names = [f.name for f in expected.fields]
    typed = F.from_json(text, T.StructType([*expected.fields, T.StructField("_fault", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_fault", "allowNonNumericNumbers": "true"})
    keys = F.json_object_keys(text)
    surplus = F.array_except(keys, F.array(*map(F.lit, names)))
    fault = F.when(F.col(text).isNull(), F.lit("no row")).when(keys.isNull(), F.lit("no object")).when(F.col("_it._fault").isNotNull(), F.lit(f"expected {expected.simpleString()}")).when(F.size(surplus) > 0, F.concat(F.lit("unknown: "), F.array_join(surplus, ", ")))
    judged = rows.withColumn("_it", typed).withColumn("error", fault)
    good = judged.where("error is null").select(*[F.col("_it")[n].alias(n) for n in names])
    return good, judged.where("error is not null").select(F.col(text).alias("text"), "error")


def writable(df: DataFrame) -> DataFrame:
    """df if an ORC file can hold it: some field, no two of one name. Raises FileError otherwise."""
    if not df.columns:
        raise FileError("a file needs at least one field")
    doubled = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if doubled:
        raise FileError(f"fields of one name: {doubled}")
    return df


def sink(df: DataFrame, path: str, compression: str | None = None, schema: T.StructType | None = None, rows_per_file: int | None = None, stripe_rows: int | None = None, block: int = BLOCK, single: bool = False) -> None:
    """Writes df as ORC files, one per task (one in all with `single`).

    rows_per_file is exact; stripe_rows is a hint that the writer rounds up to its batch. An empty df writes a file that keeps the schema.
    """
    check_schema(df, schema)
    writer = writable(df.coalesce(1) if single else df).write.mode("errorifexists").option("compression", codec(compression)).option("orc.compress.size", str(block))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if stripe_rows:
        writer = writer.option("orc.stripe.row.count", stripe_rows)
    writer.orc(path)


def reencode(spark: SparkSession, source: str, target: str, compression: str | None = None) -> DataFrame:
    """Copies files under another codec and gives the copy. Stripe boundaries are not kept."""
    df = scan(spark, source)
    sink(df, target, compression, schema=df.schema)
    return scan(spark, target)


def roundtrip(df: DataFrame, path: str, compression: str | None = None, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Writes rows and reads them back."""
    sink(df, path, compression, stripe_rows=stripe_rows)
    return scan(df.sparkSession, path)


def print_json(df: DataFrame, path: str) -> None:
    """Writes df as JSON lines in the exact layout of `json_rows`."""
    json_rows(df).write.mode("errorifexists").text(path)


def type_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The schema as rows: column_id (pre-order, root 0), path, kind."""
    out: list[tuple[int, str, str]] = []

    def walk(path: str, t: T.DataType) -> None:
        out.append((len(out), path, t.simpleString().split("<")[0]))
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{path}.{f.name}" if path else f.name, f.dataType)
        elif isinstance(t, T.ArrayType):
            walk(path + ".item", t.elementType)
        elif isinstance(t, T.MapType):
            walk(path + ".key", t.keyType)
            walk(path + ".value", t.valueType)

    walk("", schema)
    return spark.createDataFrame(out, "column_id int, path string, kind string")


def as_root(df: DataFrame, column: str) -> DataFrame:
    """A table whose root is not a struct, as a one-field struct named `value` that the renderer shows bare."""
    field = df.schema[column]
    return df.select(F.col(column).alias("value", metadata=dict(field.metadata or {}) | {"lamella.root": True}))
