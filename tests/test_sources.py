"""Files: every codec and type, footers, stripes, streams, and the checks before writing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators import assembly, chunking, columns, encodings, projection
from lamella.operators.ordered import split_lag, split_sum
from lamella.session import fresh_path, shared_folder
from lamella.sources import footer, orc, stripes
from lamella.tables import table

WIDE = "a boolean, b tinyint, c bigint, d double, e decimal(20,3), f date, g timestamp_ntz, h string, i binary, j array<int>, k array<struct<key:string,value:int>>, l struct<tag:smallint,v0:int,v1:string>"
ROWS = [
    (True, -1, 2**62, 0.5, None, dt.date(1605, 2, 28), dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), 'x"\n', bytearray(b"\x00\xff"), [1, None], [(None, 1), ("a", 2), ("a", 3)], (1, None, "w")),
    tuple(None for _ in range(12)),
]


@pytest.mark.parametrize("compression", [None, "none", "snappy", "zlib", "zstd"])
def test_every_type_and_codec_comes_back(spark, compression):
    df = spark.createDataFrame(ROWS, WIDE)
    path = fresh_path(spark, "wide")
    orc.sink(df, path, compression, single=True)
    assert sorted(map(str, orc.scan(spark, path).collect())) == sorted(map(str, df.collect()))
    f = footer.footers(spark, path).first()
    assert f["error"] is None and f["number_of_rows"] == 2 and f["compression"] == (compression or "none") and sum(s["rows"] for s in f["stripes"]) == 2
    kinds = [t["kind"] for t in f["types"]]
    assert kinds[:4] == ["STRUCT", "BOOLEAN", "BYTE", "LONG"] and len(kinds) == len(orc.type_rows(spark, df.schema).collect())
    assert {s["column_id"]: s["has_null"] for s in f["statistics"]}[1] is True
    checked = footer.check_file(spark, path)
    assert checked[2] == (compression or "none") and len(checked[0]) == 1


def test_codecs_are_checked(spark):
    for bad in ("lz4", "lzo", "ZLIB", ""):
        with pytest.raises(ValueError):
            orc.codec(bad)


def test_bad_tables_are_refused(spark):
    one = spark.range(1)
    with pytest.raises(orc.FileError):
        orc.sink(one.select("id", "id"), "/nowhere")
    with pytest.raises(orc.FileError):
        orc.sink(one.select(), "/nowhere")
    with pytest.raises(orc.FileError):
        orc.sink(one, "/nowhere", schema=spark.createDataFrame([], "id int").schema)
    assert not orc.attempt(lambda: 1 / 0).ok and orc.attempt(lambda: 3).value == 3
    with pytest.raises(orc.FileError):
        orc.with_file(spark, "/no/such/file", lambda schema, rows: rows.count())


def test_empty_files_and_files_that_are_none(spark, tmp_path):
    path = fresh_path(spark, "empty")
    orc.sink(spark.createDataFrame([], WIDE), path, single=True)
    assert orc.scan(spark, path).count() == 0 and len(orc.scan(spark, path).columns) == 12
    (tmp_path / "junk.orc").write_bytes(b"not a file of this kind")
    (tmp_path / "half.orc").write_bytes(b"ORC\x03")
    whole = fresh_path(spark, "whole").removeprefix("file://")
    orc.sink(spark.range(1), whole, single=True)
    (name,) = [x for x in os.listdir(whole) if x.endswith(".orc") and x[0] != "."]
    with open(f"{whole}/{name}", "rb") as f:
        (tmp_path / "headless.orc").write_bytes(b"CRO" + f.read()[3:])
    bad = footer.footers(spark, str(tmp_path)).collect()
    assert len(bad) == 3 and all(r["error"] for r in bad)
    with pytest.raises(ValueError):
        footer.check_file(spark, str(tmp_path))


def test_long_footers_are_read_in_full(spark):
    df = spark.range(3).select(*[F.lit(i).alias(f"a_rather_long_column_name_{i}") for i in range(900)])
    path = fresh_path(spark, "broad")
    orc.sink(df, path, single=True)
    f = footer.footers(spark, path, guess=512).first()
    assert f["error"] is None and len(f["types"]) == 901


def test_user_metadata_and_foreign_timestamps(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.orc as po

    t = pa.table({"t": pa.array([dt.datetime(1960, 1, 1, 0, 0, 0, 250_000), None], pa.timestamp("ns")), "n": [1, 2]})
    po.write_table(t, str(tmp_path / "x.orc"), compression="zlib")
    got = stripes.read_stripes(spark, str(tmp_path), "t timestamp_ntz, n bigint").orderBy("_row").collect()
    assert [r["t"] for r in got] == [dt.datetime(1960, 1, 1, 0, 0, 0, 250_000), None] and footer.footers(spark, str(tmp_path)).first()["user_metadata"] is not None


def test_stripes_keep_their_order(spark):
    df = spark.range(5_000).select("id", F.concat(F.lit("v"), "id").alias("s"))
    path = fresh_path(spark, "stripes")
    orc.sink(df, path, "zlib", stripe_rows=1_024, single=True)
    rows = stripes.read_stripes(spark, path, df.schema)
    assert rows.select("_stripe").distinct().count() > 1
    assert [r["id"] for r in rows.orderBy("_stripe", "_row").select("id").collect()] == list(range(5_000))


def test_only_the_columns_asked_for_are_read(spark):
    path = fresh_path(spark, "stripes")
    orc.sink(spark.range(3_000).select("id", (F.col("id") * 2).alias("twice"), F.lit("x").alias("s")), path, stripe_rows=1_024)
    rows = stripes.read_stripes(spark, path, "twice bigint", task_bytes=1_000)
    assert rows.columns == ["twice", "_file", "_stripe", "_row"] and rows.agg(F.sum("twice")).first()[0] == 2_999 * 3_000
    none = fresh_path(spark, "none")
    orc.sink(spark.range(0), none, single=True)
    assert stripes.read_stripes(spark, none, "id bigint").count() == 0


@pytest.mark.parametrize("compression", ["none", "snappy", "zlib", "zstd"])
def test_streams_decode_to_the_values(spark, compression):
    """Numbers that the writer packs directly, with patches, as deltas and as repeats, negative and null ones among them."""
    wide = F.when(F.col("id") % 97 == 0, F.col("id") * 10**12).otherwise(F.col("id") % 50 - 25)
    df = spark.range(3_000).select("id", wide.alias("patched"), F.lit(-7).cast("bigint").alias("same"), (F.hash("id") % 1_000).alias("any"), F.when(F.col("id") % 3 > 0, (F.col("id") * -5)).alias("gaps"))
    path = fresh_path(spark, "coded")
    orc.sink(df, path, compression, single=True, stripe_rows=1_024)
    got = footer.whole_numbers(spark, path, [1, 2, 3, 4, 5]).collect()
    for i, c in enumerate(df.columns, 1):
        assert [r["value"] for r in sorted(got, key=lambda r: (r["column_id"], r["stripe_no"], r["present"])) if r["column_id"] == i] == [r[0] for r in df.where(F.col(c).isNotNull()).orderBy("id").select(c).collect()], c
    feet = footer.stripe_footers(spark, path).collect()
    assert sum(r["rows"] for r in feet) == 3_000 and all({(s["column_id"], s["stream"]) for s in r["streams"]} >= {(5, "PRESENT"), (5, "DATA"), (1, "ROW_INDEX")} for r in feet)
    assert {r["writer_timezone"] for r in feet} == {None}  # the writer states its zone where there are timestamps
    zoned = fresh_path(spark, "zoned")
    orc.sink(spark.range(5).select(F.timestamp_seconds("id").alias("t")), zoned, compression, single=True)
    r = footer.stripe_footers(spark, zoned).first()
    assert r["writer_timezone"] and [tuple(e) for e in r["encodings"]] == [(0, "DIRECT", None), (1, "DIRECT_V2", None)] and (1, "SECONDARY") in {(s["column_id"], s["stream"]) for s in r["streams"]}


def test_statistics_are_typed(spark):
    rows = [(True, -5, 2.5, "b", dt.date(1969, 12, 30), bytearray(b"xyz")), (False, 9, -1.0, "añ", dt.date(2020, 1, 2), None), (True, None, None, None, None, bytearray(b""))]
    path = fresh_path(spark, "typed")
    orc.sink(spark.createDataFrame(rows, "a boolean, b int, c double, d string, e date, f binary").withColumn("g", F.col("b").cast("decimal(9,2)")), path, single=True)
    got = [(s["minimum"], s["maximum"], s["total"]) for s in footer.footers(spark, path).first()["statistics"]]
    assert got[1:6] == [(None, None, "2"), ("-5", "9", "4"), ("-1.0", "2.5", "1.5"), ("añ", "b", "4"), ("1969-12-30", "2020-01-02", None)]
    assert got[6] == (None, None, "3") and [float(x) for x in got[7]] == [-5, 9, 4]


def test_rows_of_text_are_checked(spark):
    texts = ['{"a": 1, "b": ["x", null]}', '{"b": []}', "{}", '{"a": "1"}', '{"a": 1.5}', '{"a": 3000000000}', '{"a": 1, "c": 2}', "[1]", '{"a": 1', "", None]
    good, bad = orc.checked_rows(spark.createDataFrame([(t,) for t in texts], "text string"), "text", T.StructType.fromDDL("a int, b array<string>"))
    assert [tuple(r) for r in good.collect()] == [(1, ["x", None]), (None, []), (None, None)]
    assert [r["text"] for r in bad.collect()] == texts[3:] and all(r["error"] for r in bad.collect())


def test_a_table_is_counted_while_it_is_written(spark):
    from lamella.streaming import orc_stream

    df, figures = orc_stream.observed(spark.range(50), "seen", n=F.count("*"), most=F.max("id"))
    orc.sink(df, fresh_path(spark, "seen"))
    assert figures() == {"n": 50, "most": 49}


def test_rows_per_file(spark):
    path = fresh_path(spark, "sized")
    orc.sink(spark.range(25), path, rows_per_file=10, single=True)
    assert sorted(r["number_of_rows"] for r in footer.footers(spark, path).collect()) == [5, 10, 10]


def test_filters_and_columns_reach_the_reader(spark):
    path = fresh_path(spark, "pushed")
    orc.sink(spark.range(100).select("id", F.col("id").alias("other")), path)
    plan = orc.scan(spark, path).where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "other" not in plan.split("ReadSchema")[1]


def test_streams(spark):
    from lamella.streaming import orc_stream

    df = spark.createDataFrame([("a", "xy"), ("a", None), (None, "é"), ("b", "")], "k string, v string")
    source, target = fresh_path(spark, "in"), fresh_path(spark, "out")
    orc.sink(df, source)
    stream = orc_stream.read_stream(spark, source, df.schema)
    state = fresh_path(spark, "state")
    for _ in range(2):  # a restart adds nothing
        orc_stream.write_stream(stream, target, state).awaitTermination()
    assert sorted(map(str, spark.read.orc(target).collect())) == sorted(map(str, df.collect()))
    q = orc_stream.running_lengths(orc_stream.read_stream(spark, source, df.schema), "k", "v").writeStream.format("memory").queryName("lengths").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["key"]: (r["chunks"], r["bytes"]) for r in spark.table("lengths").orderBy("chunks").collect()}
    assert last == {"a": (2, 2), "b": (1, 0), None: (1, 2)}


def test_append_is_strict(spark):
    a = spark.createDataFrame([(1, "x")], "p int, q string")
    assert columns.append(a, a).count() == 2 and columns.concat(spark, a.schema, []).count() == 0
    for other in ("q string, p int", "p int, r string", "p bigint, q string", "p int"):
        with pytest.raises(orc.FileError):
            columns.append(a, columns.empty_of(spark, other))
    assert columns.length(a).first()["n"] == 1 and columns.length(spark.range(5).select()).first()["n"] == 0


def test_projection_is_exact(spark):
    df = spark.createDataFrame(ROWS[:1], WIDE)
    assert df.select(projection.take(df, "b", "BYTE"), projection.take(df, "f", "DATE")).first()[0:2] == (255, -133_255)
    with pytest.raises(orc.FileError):
        projection.take(df, "c", "INT")
    assert df.select(projection.try_take(df, "c", "INT").alias("x")).first()["x"] is None
    assert df.select(projection.union_variant(df, "l", 1).alias("x")).first()["x"] == "w"
    with pytest.raises(orc.FileError):
        projection.union_variant(df, "l", 2)


def test_transposing_passes_over_short_rows(spark):
    df = spark.createDataFrame([(0, [10, 11]), (1, [20]), (2, []), (3, [30, 31, 32]), (4, None)], "o bigint, v array<int>")
    got = {}
    for r in assembly.transpose(df, "o", "v").orderBy("pos", "k").collect():
        got.setdefault(r["pos"], []).append(r["value"])
    assert list(got.values()) == [[10, 20, 30], [11, 31], [32]]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_rechunking_keeps_every_byte(spark, size):
    pieces = ["", "abc", None, "é", "0123456789", "z"]
    df = spark.createDataFrame(list(enumerate(pieces)), "o bigint, p string")
    out = chunking.resize_chunks(df, "o", "p", size, block=2).orderBy("chunk").collect()
    whole = "".join(p or "" for p in pieces).encode()
    assert b"".join(bytes(r["body"]) for r in out) == whole and all(len(r["body"]) == size for r in out[:-1])
    with pytest.raises(ValueError):
        chunking.resize_chunks(df, "o", "p", 0)


def test_union_tags_are_checked(spark):
    df = spark.createDataFrame([(0, 0, (5, None, "x"))], "chunk bigint, ordinal bigint, u struct<tag:smallint,v0:int,v1:string>")
    tags, _ = assembly.split_union(df, "u", ["v0", "v1"])
    with pytest.raises(Exception, match="no variant"):
        tags.collect()


def test_dictionaries_and_runs(spark):
    rows = [(0, i, v) for i, v in enumerate(["b", "a", "b", None, "b", "a"])] + [(1, i, str(i)) for i in range(4)] + [(2, 0, "x"), (2, 1, "x")]
    df = spark.createDataFrame(rows, "chunk bigint, ordinal bigint, v string")
    assert {r["chunk"]: r["dictionary"] for r in encodings.dictionary_decision(df, "v").collect()} == {0: True, 1: False, 2: False}
    assert [(r["id"], r["value"]) for r in encodings.dictionary(df, "v").where("chunk = 0").orderBy("id").collect()] == [(0, "b"), (1, "a")]
    back = encodings.dictionary_decode(encodings.dictionary_encode(df, "v"), encodings.dictionary(df, "v"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("chunk", "ordinal", F.col("v").alias("value")).collect()))
    assert encodings.equal_runs(df, "v").count() == 6 + 4 + 1


def test_split_windows_equal_plain_ones(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 7 > 0, F.col("id") * 3).alias("v"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    w = Window.partitionBy("k").orderBy("o")
    plain = df.withColumn("p", F.lag("v").over(w)).withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    split = split_sum(split_lag(df, ["k"], ["o"], F.expr("o div 11"), {"p": "v"}), ["k"], ["o"], F.expr("o div 13"), "v", "s")
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_the_folder_is_the_cluster_s(spark):
    assert os.path.isdir(shared_folder(spark).removeprefix("file://"))


def test_tables_read(spark, data):
    assert table(spark, data, "nation").count() == 25
