"""Rows as JSON text in an exact layout: a recursive function from a schema to a Catalyst expression.

Layout: `{"a": 1, "b": null}`, `[a, b]`, maps as lists of `{"key": k, "value": v}`, unions as `{"tag": n, "value": v}`, binary as lists of unsigned bytes,
bytes unsigned, years without padding, nine fractional digits, and numbers with a fraction as `12.0`, `1.0e-2`, `NaN`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.civil import _micros, timestamp_to_datetime

#: Field metadata that marks a logical type: {"kind": "union" | "map" | "timestamp" | "byte" | "decimal"}.
KIND = "lamella.kind"
#: Control characters with a short escape: fixed values.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def text(value: Column) -> Column:
    """A quoted string; control characters without a short escape become \\u00xx. The usual string, without any, is only looked through."""
    rare = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(_short(c))), "")
    escaped = F.when(value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).when(value.rlike(r'["\\\n\r\t]'), _short(value)).otherwise(value)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _short(v: Column) -> Column:
    for c, e in SHORT.items():
        v = F.replace(v, F.lit(c), F.lit(e))
    return v


def fraction(value: Column) -> Column:
    """A float or double, with the digits that the JVM prints: an exponent below 0.1 and from ten million, at least one digit after the point."""
    s = F.replace(value.cast("string"), F.lit("E"), F.lit("e"))
    small = s
    # the JVM writes 0.001 to 0.1 without an exponent
    for zeros in (1, 2):
        small = F.regexp_replace(small, rf"^(-?)0\.{'0' * zeros}([1-9])(\d*)$", f"$1$2.$3e-{zeros + 1}")
    return F.when(F.abs(value) < 0.1, F.replace(small, F.lit(".e"), F.lit(".0e"))).otherwise(s)


def _laid(plain: Column) -> Column:
    """A decimal text without exponent, laid out like a fraction; trailing zeros don't show."""
    s = F.when(F.instr(plain, ".") > 0, plain).otherwise(F.concat(plain, F.lit(".0")))
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    large, small = r"^(-?)([1-9])(\d{7,})\.(\d*)$", r"^(-?)0\.(0+)([1-9])(\d*)$"
    as_large = F.concat(trimmed(F.regexp_replace(s, large, "$1$2.$3$4")), F.lit("e"), F.length(F.regexp_extract(s, large, 3)).cast("string"))
    as_small = F.concat(trimmed(F.regexp_replace(s, small, "$1$3.$4")), F.lit("e-"), (F.length(F.regexp_extract(s, small, 2)) + 1).cast("string"))
    return F.when(s.rlike(large), as_large).when(s.rlike(small), as_small).otherwise(trimmed(s))


def decimal(value: Column) -> Column:
    """A decimal of uniform scale."""
    return F.regexp_replace(_laid(value.cast("string")), r"^-(0\.0)$", "$1")


def scaled(value: Column) -> Column:
    """A decimal with its own scale, as struct(unscaled, scale)."""
    u = F.regexp_replace(value["unscaled"].cast("string"), "^-", "")
    scale = value["scale"].cast("int")
    wide = F.lpad(u, F.greatest(F.length(u), scale + 1), "0")
    pointed = F.concat(F.substring(wide, F.lit(1), F.length(wide) - scale), F.lit("."), F.right(wide, scale))
    plain = F.when(scale > 0, pointed).when(value["unscaled"] == 0, F.lit("0")).otherwise(F.concat(u, F.repeat(F.lit("0"), -scale)))
    return F.concat(F.when(value["unscaled"] < 0, F.lit("-")).otherwise(F.lit("")), _laid(plain))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def date(value: Column) -> Column:
    return F.concat(F.lit('"'), F.year(value).cast("string"), F.lit("-"), _two(F.month(value)), F.lit("-"), _two(F.dayofmonth(value)), F.lit('"'))


def moment(day: Column, nano: Column) -> Column:
    s = F.floor(nano / 1_000_000_000)
    clock = F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s / 60) % 60), _two(s % 60))
    ymd = F.concat(F.year(day).cast("string"), F.lit("-"), _two(F.month(day)), F.lit("-"), _two(F.dayofmonth(day)))
    return F.concat(F.lit('"'), ymd, F.lit("T"), clock, F.lit("."), F.lpad((nano - s * 1_000_000_000).cast("string"), 9, "0"), F.lit('"'))


def binary(value: Column) -> Column:
    """A list of unsigned bytes."""
    h = F.hex(value)
    places = F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.lit("["), F.array_join(F.transform(places, lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10)), ", "), F.lit("]"))


def _list(inner: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))


def render(value: Column, kind: T.DataType, logical: str | None = None) -> Column:
    """The JSON text of a value; null gives `null`. logical: what the field's metadata says of it."""
    if logical == "union":
        whole, variants = value, [f for f in kind.fields if f.name != "tag"]
        inner = F.lit("null")
        for i, f in reversed(list(enumerate(variants))):
            inner = F.when(whole["tag"] == i, render(whole[f.name], f.dataType, f.metadata.get(KIND))).otherwise(inner)
        body = F.concat(F.lit('{"tag": '), F.coalesce(whole["tag"].cast("string"), F.lit("null")), F.lit(', "value": '), inner, F.lit("}"))
    elif logical == "timestamp":
        parts = timestamp_to_datetime(value["seconds"], value["nanos"])
        body = moment(parts["date"], parts["nano_of_day"])
    elif logical == "decimal":
        body = scaled(value)
    elif logical == "byte" or isinstance(kind, T.ByteType):
        body = value.cast("smallint").bitwiseAND(F.lit(255).cast("smallint")).cast("string")
    elif isinstance(kind, T.StructType):
        body = record([(f.name, value[f.name], f.dataType, f.metadata.get(KIND)) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        body = _list(F.transform(value, lambda x: render(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(F.lit('{"key": '), render(e["key"], kind.keyType), F.lit(', "value": '), render(e["value"], kind.valueType), F.lit("}"))
        body = _list(F.transform(F.map_entries(value), pair))
    elif isinstance(kind, T.DecimalType):
        body = decimal(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        body = fraction(value)
    elif isinstance(kind, T.DateType):
        body = date(value)
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        us = _micros(value) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(value)
        day = F.floor(us / 86_400_000_000)
        body = moment(F.date_from_unix_date(day.cast("int")), (us - day * 86_400_000_000) * 1_000)
    elif isinstance(kind, T.BinaryType):
        body = binary(value)
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        body = text(value)
    else:
        body = value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), body), F.lit("null"))


def record(fields: list[tuple[str, Column, T.DataType, str | None]]) -> Column:
    named = [F.concat(text(F.lit(n)), F.lit(": "), render(v, k, m)) for n, v, k, m in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *named), F.lit("}")) if named else F.lit("{}")


def json_rows(df, name: str = "value"):
    """df as one column of JSON texts, a line for each row. A table whose only column is named `value` and marked as a root renders that value bare."""
    schema = df.schema
    if len(schema) == 1 and schema[0].metadata.get("lamella.root"):
        f = schema[0]
        return df.select(render(df[f.name], f.dataType, f.metadata.get(KIND)).alias(name))
    return df.select(record([(f.name, df[f.name], f.dataType, f.metadata.get(KIND)) for f in schema.fields]).alias(name))
