"""Civil time, bits, JSON text and byte layouts: golden values, round trips and random values."""

import datetime as dt
import decimal
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import bits, civil, codecs, jsontext


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_days(spark):
    days = spark.createDataFrame([(0,), (-133_255,), (16_436,), (None,)], "d bigint").select(civil.day_to_date("d").alias("x")).collect()
    assert [tuple(r["x"]) if r["x"] else None for r in days] == [(1970, 1, 1), (1605, 2, 28), (2015, 1, 1), None]
    assert one(spark, civil.date_to_day(F.lit(1605), F.lit(2), F.lit(28))) == (-133_255,)


@pytest.mark.parametrize("s, n", [(0, 0), (-1, 500_000_000), (86_399, 999_999_999), (-86_400, 0), (-1_420_070_401, 5), (10**10, 1)])
def test_timestamps_round_trip(spark, s, n):
    when = civil.timestamp_to_datetime(F.lit(s).cast("bigint"), F.lit(n).cast("bigint"))
    (t, back) = one(spark, when, civil.datetime_to_timestamp(when["date"], when["nano_of_day"]))
    expected = dt.datetime(2015, 1, 1) + dt.timedelta(seconds=s)
    assert t["date"] == expected.date() and t["nano_of_day"] == (expected.hour * 3600 + expected.minute * 60 + expected.second) * 10**9 + n
    assert tuple(back) == (s, n)


def test_nanoseconds(spark):
    values = [0, 1, 10, 100, 1_000, 100_000, 999_999_999, 120_000_000, 500]
    rows = spark.createDataFrame([(v,) for v in values], "n bigint").select("n", civil.encode_nanoseconds("n").alias("c")).select("n", "c", civil.decode_nanoseconds("c").alias("b")).collect()
    assert all(r["b"] == r["n"] for r in rows)
    assert {r["n"]: r["c"] for r in rows if r["n"] in (0, 1, 10, 1_000, 100_000)} == {0: 0, 1: 8, 10: 80, 1_000: 0x0A, 100_000: 0x0C}


def test_zigzag(spark):
    values = [0, -1, 1, -3, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(v,) for v in values], "n bigint").select("n", bits.zigzag("n").alias("c")).select("n", "c", bits.unzigzag("c").alias("b"), bits.unzigzag_wide(bits.zigzag_wide("n")).cast("bigint").alias("w")).collect()
    assert all(r["b"] == r["w"] == r["n"] for r in rows)
    assert [r["c"] for r in rows[:4]] == [0, 1, 2, 5] and rows[-1]["c"] == -1


def test_widths_and_byte_orders(spark):
    widths = [r[0] for r in spark.range(33).select(bits.bit_width("id")).collect()]
    assert widths == [*range(1, 25), 26, 28, 30, 32, 40, 48, 56, 64, None]
    b = F.unhex(F.lit("8000012345678901"))
    assert one(spark, bits.word24_le(F.unhex(F.lit("010203"))), F.hex(bits.word24_le_bytes(F.lit(197_121))), bits.big_endian(b, 2, signed=False), bits.sign_magnitude(F.unhex(F.lit("8005")), 2), bits.sign_magnitude(b, 8), bits.unsigned_byte(F.lit(-1).cast("tinyint"))) == (197_121, "010203", 32_768, -5, -0x12345678901, 255)


FLOATS = {0.0: "0.0", 1.0: "1.0", 0.1: "0.1", 0.01: "1.0e-2", -0.0123: "-1.23e-2", 0.001: "1.0e-3", 0.00025: "2.5e-4", 9_999_999.5: "9999999.5", 1e7: "1.0e7", 1.25e20: "1.25e20", 5e-324: "4.9e-324", math.inf: "Infinity", -math.inf: "-Infinity", math.nan: "NaN"}


def test_fractions(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(FLOATS)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", jsontext.fraction(F.col("v"))).collect()}
    assert got == dict(enumerate(FLOATS.values()))
    assert one(spark, jsontext.fraction(F.lit(-0.0)), jsontext.fraction(F.lit(0.1).cast("float"))) == ("-0.0", "0.1")


def scientific(x: decimal.Decimal) -> str:
    """Fixed from 0.1 up to ten million, else one digit before the point and an exponent."""
    if x == 0:
        return "0.0"
    sign, digits, e = x.normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + e
    if 0 <= point <= 7:
        whole, rest = (d[:point].ljust(point, "0") or "0"), d[point:] or "0"
        out = f"{whole}.{rest}"
    else:
        out = f"{d[0]}.{d[1:] or '0'}e{point - 1}"
    return ("-" if sign else "") + out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(-(10**17), 10**17, allow_nan=False, places=6), min_size=1, max_size=60))
def test_decimals(spark, values):
    df = spark.createDataFrame([(i, v, decimal.Decimal(int(v.scaleb(6)))) for i, v in enumerate(values)], "i int, v decimal(38,6), u decimal(38,0)")
    s = F.struct(F.col("u").alias("unscaled"), F.lit(6).cast("tinyint").alias("scale"))
    for r in df.select("i", jsontext.decimal(F.col("v")).alias("a"), jsontext.scaled(s).alias("b")).collect():
        assert r["a"] == r["b"] == scientific(values[r["i"]])


def test_json_layout(spark):
    kind = jsontext.KIND
    schema = T.StructType([
        T.StructField("t", T.BooleanType()), T.StructField("b", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("x", T.BinaryType()), T.StructField("d", T.DateType()),
        T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("r", T.StructType([T.StructField("a", T.LongType())])),
        T.StructField("u", T.StructType([T.StructField("tag", T.ShortType()), T.StructField("v0", T.LongType()), T.StructField("v1", T.StringType())]), metadata={kind: "union"}),
        T.StructField("ts", T.StructType([T.StructField("seconds", T.LongType()), T.StructField("nanos", T.LongType())]), metadata={kind: "timestamp"}),
    ])
    full = (True, -1, 'q"\\\n\r\t\x01\x08é', bytearray(b"\x00\xff"), dt.date(987, 6, 5), [1, None], {"k": None}, (7,), (1, None, "w"), (-1, 5))
    rows = spark.createDataFrame([full, tuple(None for _ in full), (False, 1, "", bytearray(), dt.date(2000, 1, 1), [], {}, (None,), (0, None, None), (0, 0))], schema)
    assert [r[0] for r in jsontext.json_rows(rows).collect()] == [
        '{"t": true, "b": 255, "s": "q\\"\\\\\\n\\r\\t\\u0001\\u0008é", "x": [0, 255], "d": "987-06-05", "l": [1, null], "m": [{"key": "k", "value": null}], "r": {"a": 7}, "u": {"tag": 1, "value": "w"}, "ts": "2014-12-31T23:59:59.000000005"}',
        '{"t": null, "b": null, "s": null, "x": null, "d": null, "l": null, "m": null, "r": null, "u": null, "ts": null}',
        '{"t": false, "b": 1, "s": "", "x": [], "d": "2000-01-01", "l": [], "m": [], "r": {"a": null}, "u": {"tag": 0, "value": null}, "ts": "2015-01-01T00:00:00.000000000"}',
    ]


NUMBERS = st.one_of(st.integers(-3, 3), st.integers(-(2**63), 2**63 - 1), st.integers(250, 310))


@settings(max_examples=300, deadline=None)
@given(st.lists(NUMBERS, max_size=400))
def test_runs_round_trip(values):
    assert codecs.decode_runs(codecs.encode_runs(values)) == values
    assert codecs.decode_varints(codecs.encode_varints(values)) == values
    plain = [abs(v) for v in values]
    assert codecs.decode_runs(codecs.encode_runs(plain, False), False) == plain


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=600), st.lists(st.booleans(), max_size=300))
def test_bytes_and_bits_round_trip(data, flags):
    assert codecs.decode_bytes(codecs.encode_bytes(data)) == data
    assert codecs.decode_bits(codecs.encode_bits(flags), len(flags)) == flags


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 64), st.data())
def test_packed_round_trip(width, data):
    values = data.draw(st.lists(st.integers(0, 2**width - 1), max_size=50))
    assert codecs.unpack(codecs.pack(values, width), width, len(values)) == values


def test_layouts_of_the_specification():
    assert codecs.encode_runs([7] * 100) == bytes.fromhex("61000e") and codecs.encode_runs([7] * 100, False) == bytes.fromhex("610007")
    assert codecs.decode_runs(bytes.fromhex("610007"), False) == [7] * 100
    assert codecs.encode_runs(range(100, 0, -1), False) == bytes.fromhex("61ff64")
    assert codecs.encode_bytes(bytes(100)) == bytes.fromhex("6100") and codecs.encode_bytes(b"\x44\x45") == bytes.fromhex("fe4445")
    two = lambda h: codecs.decode_runs_2(bytes.fromhex(h), False)
    assert two("0a2710") == [10_000] * 5
    assert two("5e035ca1ab1edeadbeef") == [23_713, 43_806, 57_005, 48_879]
    assert two("8e132b2107d01e00147028323c46505a646e78828c96a0aab4befce8") == [2030, 2000, 2020, 1_000_000, *range(2040, 2200, 10)]
    assert codecs.decode_runs_2(bytes.fromhex("c609020222424246"), False) == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert two("c0090202") == list(range(2, 12))


def test_whole_values_are_compared():
    for values in ([1, 2, 3, 260], [300, 301, 302, 303, 304], [1, 2, 3, 4, 261]):
        assert codecs.decode_runs(codecs.encode_runs(values)) == values
    assert codecs.encode_runs([300, 301, 302, 303, 304])[0] == 2


def test_early_ends_raise():
    for decode, data in ((codecs.decode_runs, b"\x61"), (codecs.decode_runs, b"\xfe\x80"), (codecs.decode_bytes, b"\xfe\x44"), (codecs.decode_varints, b"\x80"), (codecs.decode_runs_2, b"\x5e\x03\x5c"), (codecs.decode_floats, b"\x00")):
        with pytest.raises(ValueError):
            decode(data)
