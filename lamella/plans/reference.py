"""Queries for the operators on files, columns, encodings and text layout, each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import bits, civil, codecs, jsontext
from lamella.operators import assembly, chunking, columns, encodings, projection
from lamella.session import fresh_path, spread
from lamella.sources import footer, orc, stripes
from lamella.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _stored(df: DataFrame, what: str, compression: str | None = None, **options) -> str:
    path = fresh_path(df.sparkSession, what)
    orc.sink(df, path, compression, **options)
    return path


def _chunked_lineitem(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """lineitem in stripes of 10,000 rows by order and line; the other columns settle ties."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = table(spark, d, "lineitem").select(*dict.fromkeys([*order, *more]))
    return assembly.chunked(rows, order, F.expr("l_orderkey div 2000"), orc.STRIPE_ROWS).select("l_orderkey", "l_linenumber", *{m: 0 for m in more if m not in ("l_orderkey", "l_linenumber")}, "ordinal", "chunk")


def _chunked_events(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return assembly.chunked(table(spark, d, "events").select("event_id", *more), ["event_id"], F.expr("event_id div 8192"), 1_000)


# ---- sources and sinks


@query
def scan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows through an uncompressed file and back."""
    return orc.scan(spark, _stored(table(spark, d, "lineitem"), "scan"))


@query
def scan_pushed(spark: SparkSession, d: str) -> DataFrame:
    """A filter and two columns of a file; both reach the reader."""
    return orc.scan(spark, _stored(table(spark, d, "lineitem"), "scan")).where("l_quantity >= 45").select("l_orderkey", "l_quantity")


@query
def scan_continued(spark: SparkSession, d: str) -> DataFrame:
    """A file opened with a continuation that gets schema and rows."""
    path = _stored(table(spark, d, "orders"), "scan")
    return orc.with_file(spark, path, lambda schema, rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.lit(len(schema)).alias("fields")))


@query
def scan_attempted(spark: SparkSession, d: str) -> DataFrame:
    """Errors as values: a good file and a missing one."""
    path = _stored(table(spark, d, "orders"), "scan")
    tried = {"good": orc.attempt(lambda: orc.scan(spark, path).count()), "missing": orc.attempt(lambda: orc.scan(spark, path + "-none").count())}
    return spark.createDataFrame([(k, r.ok, r.value) for k, r in tried.items()], "name string, ok boolean, n bigint")


@query
def scan_stripes(spark: SparkSession, d: str) -> DataFrame:
    """Rows read stripe by stripe through the data source."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = _stored(df, "stripes", "zlib", stripe_rows=1_024)
    return stripes.read_stripes(spark, path, df.schema).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("_file", "_stripe", "_row").alias("places"))


@query
def meta_footers(spark: SparkSession, d: str) -> DataFrame:
    """Footers of written files: rows by footer and by stripe, codec, columns."""
    path = _stored(table(spark, d, "lineitem"), "footers", "zstd")
    f = footer.footers(spark, path)
    rows = F.aggregate("stripes", F.lit(0).cast("bigint"), lambda a, s: a + s["rows"])
    return f.groupBy("compression", "block_size").agg(F.sum("number_of_rows").alias("n"), F.sum(rows).alias("stripe_rows"), F.max(F.size("types")).alias("types"), F.count("error").alias("errors"))


@query
def meta_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Values and nulls of each column as the footers state them."""
    path = _stored(table(spark, d, "documents").select("doc_id", "lang", "family_id", "n_claims"), "statistics", "snappy")
    s = footer.footers(spark, path).select(F.explode("statistics").alias("s"))
    return s.groupBy(F.col("s.column_id").alias("column_id")).agg(F.sum("s.number_of_values").alias("number_of_values"), F.max("s.has_null").alias("has_null"))


@query
def meta_types(spark: SparkSession, d: str) -> DataFrame:
    """The type tree of a file in pre-order."""
    return orc.type_rows(spark, orc.scan(spark, _stored(table(spark, d, "embeddings"), "types")).schema)


@query
def meta_registered(spark: SparkSession, d: str) -> DataFrame:
    """Registered footers, each file once, with the date order from the user metadata."""
    from lamella.operators.registry import registered_files

    return registered_files(table(spark, d, "orc_files")).select("file_id", "feed_id", "number_of_rows", "date_order")


@query
def meta_stripes(spark: SparkSession, d: str) -> DataFrame:
    """Stripe footers of written files: the encoding of each column with the rows of its stripes, and whether the writer's zone is there."""
    path = _stored(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("l_shipdate")), "stripe-footers", "zlib")
    f = footer.stripe_footers(spark, path)
    each = f.select("rows", F.col("writer_timezone").isNotNull().alias("zone"), F.size("streams").alias("streams"), F.explode("encodings").alias("e"))
    return each.groupBy(F.col("e.column_id").alias("column_id"), F.col("e.encoding").alias("encoding")).agg(F.sum("rows").alias("n"), F.expr("every(zone)").alias("zone"), F.expr("every(streams > 5)").alias("streams"))


@query
def meta_typed(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest values and totals as the footers state them."""
    path = _stored(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "typed", "snappy")
    s = footer.footers(spark, path).select(F.explode("statistics").alias("s")).select("s.*").where("column_id > 0")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return s.groupBy("column_id").agg(F.sum("number_of_values").alias("n"), F.min(number("minimum")).alias("least"), F.max(number("maximum")).alias("most"), F.sum(number("total")).alias("total"), F.min("minimum").alias("first_text")).select(
        "column_id", "n", "least", "most", "total", F.when(F.col("column_id") == 2, F.col("first_text")).alias("first_text")
    )


@query
def meta_items(spark: SparkSession, d: str) -> DataFrame:
    """User metadata that the writer leaves in each file."""
    path = _stored(table(spark, d, "region"), "items", single=True)
    return footer.footers(spark, path).select(F.explode("user_metadata").alias("x")).select("x.item_name", F.col("x.item_value").startswith("4.").alias("four"))


@query
def meta_checked(spark: SparkSession, d: str) -> DataFrame:
    """A file's stripes, fields and codec without its data; one that is none gives an error."""
    path = _stored(table(spark, d, "orders"), "checked", "zstd", single=True)
    good, bad = orc.attempt(lambda: footer.check_file(spark, path)), orc.attempt(lambda: footer.check_file(spark, path + "/_SUCCESS"))
    rows = [("good", good.ok, sum(s["rows"] for s in good.value[0]), good.value[2]), ("bad", bad.ok, None, None)]
    return spark.createDataFrame(rows, "name string, ok boolean, n bigint, codec string")


@query
def scan_streams(spark: SparkSession, d: str) -> DataFrame:
    """Whole-number columns decoded from the streams of a file that Spark wrote: deltas, packed numbers and short repeats."""
    path = _stored(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "streams", "zlib")
    return footer.whole_numbers(spark, path, [1, 2, 3]).groupBy("column_id", "value").agg(F.count("*").alias("n"))


@query
def sink_attempted(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a sink as values: a good table, one with two fields of one name, an unknown codec, another schema."""
    r = table(spark, d, "region")
    tries = {
        "good": lambda: orc.sink(r, fresh_path(spark, "tried")),
        "doubled": lambda: orc.sink(r.select("r_name", "r_name"), fresh_path(spark, "tried")),
        "codec": lambda: orc.sink(r, fresh_path(spark, "tried"), "lzma"),
        "schema": lambda: orc.sink(r, fresh_path(spark, "tried"), schema=r.select("r_name").schema),
    }
    return spark.createDataFrame([(k, orc.attempt(f).ok) for k, f in tries.items()], "name string, ok boolean")


@query
def sink_rows_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Files of exactly 1,000 rows, the last shorter."""
    path = _stored(table(spark, d, "orders"), "sized", "zlib", rows_per_file=1_000, single=True)
    return footer.footers(spark, path).groupBy("number_of_rows").agg(F.count("*").alias("files"))


@query
def sink_empty(spark: SparkSession, d: str) -> DataFrame:
    """A table without rows keeps its schema in a file."""
    path = _stored(table(spark, d, "nation").where("false"), "empty", single=True)
    return orc.type_rows(spark, orc.scan(spark, path).schema).where("column_id > 0").select("path", "kind")


def _reencode(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        source = _stored(table(spark, d, "orders"), "reencode")
        return orc.reencode(spark, source, fresh_path(spark, "reencoded"), name)

    run.__name__, run.__doc__ = f"sink_reencode_{name}", f"Files copied with codec {name}."
    query(run)


for _name in orc.CODECS:
    _reencode(_name)


@query
def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows through a file with stripes of 1,024 rows."""
    return orc.roundtrip(table(spark, d, "events"), fresh_path(spark, "roundtrip"), "snappy", 1_024)


@query
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written as text and read back."""
    path = fresh_path(spark, "json")
    orc.print_json(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return spark.read.text(path)


# ---- projection


@query
def proj_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Columns as exactly their kinds."""
    r = table(spark, d, "row_records")
    kinds = {"c_bool": "BOOLEAN", "c_byte": "BYTE", "c_short": "SHORT", "c_int": "INT", "c_long": "LONG", "c_float": "FLOAT", "c_double": "DOUBLE", "c_dec": "DECIMAL", "c_date": "DATE", "c_str": "STRING", "c_varchar": "VARCHAR", "c_char": "CHAR"}
    return r.select("record_id", *[projection.take(r, c, k).alias(c) for c, k in kinds.items()])


@query
def proj_composites(spark: SparkSession, d: str) -> DataFrame:
    """A timestamp, a list and a binary column as exactly their kinds."""
    e = table(spark, d, "embeddings")
    lists = e.select(F.col("vec_id").alias("id"), F.size(projection.take(e, "embedding", "LIST")).alias("size"), F.lit(None).cast("timestamp_ntz").alias("moment"), F.lit(None).cast("string").alias("bytes"))
    v = table(spark, d, "events").select("event_id", "ts", F.col("event_type").cast("binary").alias("body"))
    rest = v.select(F.col("event_id").alias("id"), F.lit(None).cast("int").alias("size"), projection.take(v, "ts", "TIMESTAMP").alias("moment"), F.hex(projection.take(v, "body", "BINARY")).alias("bytes"))
    return lists.unionByName(rest)


@query
def proj_struct(spark: SparkSession, d: str) -> DataFrame:
    """A struct's fields by name and by position."""
    r = table(spark, d, "row_records")
    return r.select("record_id", *projection.struct_fields(r, "c_ts"), *projection.anonymous_fields(r, "c_ts"))


def _union(spark: SparkSession, d: str) -> DataFrame:
    tag = (F.col("event_id") % 2).cast("smallint")
    u = F.struct(tag.alias("tag"), F.when(tag == 0, F.col("value")).alias("v0"), F.when(tag == 1, F.col("event_type")).alias("v1"))
    return _chunked_events(spark, d, "value", "event_type").select("event_id", "chunk", "ordinal", u.alias("u"))


@query
def proj_union(spark: SparkSession, d: str) -> DataFrame:
    """A union's tag and the values of its variants."""
    u = _union(spark, d)
    return u.select("event_id", F.col("u.tag").cast("int").alias("tag"), projection.union_variant(u, "u", 0).alias("number"), projection.union_variant(u, "u", 1).alias("word"))


@query
def proj_variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one variant."""
    return projection.of_variant(_union(spark, d), "u", 1).select("event_id", F.col("u.v1").alias("word"))


@query
def proj_map(spark: SparkSession, d: str) -> DataFrame:
    """A map's pairs."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    return n.select("n_regionkey", F.posexplode(projection.map_pairs(n, "m")).alias("pos", "e")).select("n_regionkey", "pos", F.col("e.key").alias("n_name"), F.col("e.value").alias("n_nationkey"))


@query
def proj_present(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a value."""
    return projection.present(table(spark, d, "documents"), "lang").select("doc_id", "lang")


@query
def proj_consumer(spark: SparkSession, d: str) -> DataFrame:
    """A consumer's own filter, map and fold over the rows."""
    rows = orc.scan(spark, _stored(table(spark, d, "lineitem"), "scan"))
    return rows.where("l_discount > 0.05").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- columns


@query
def col_presence(spark: SparkSession, d: str) -> DataFrame:
    """Presence and packed values, and both merged again."""
    it = assembly.chunked(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], F.expr("doc_id div 4096"), 1_000)
    merged = assembly.merge_presence(*assembly.split_presence(it, "lang"))
    return it.select("chunk", "ordinal", "doc_id").join(merged, ["chunk", "ordinal"]).select("doc_id", "chunk", F.col("value").alias("lang"))


@query
def col_presence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and present values of each chunk, and whether it needs a presence column."""
    it = assembly.chunked(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], F.expr("doc_id div 4096"), 1_000)
    return it.groupBy("chunk").agg(F.count("*").alias("n"), F.count("lang").alias("present"), (F.count("*") > F.count("lang")).alias("partial"))


@query
def col_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists as lengths and children, assembled again, element by element."""
    lengths, children = assembly.split_lists(table(spark, d, "embeddings"), "vec_id", "embedding")
    again = assembly.join_lists(lengths, children, "vec_id")
    return again.select("vec_id", F.posexplode("items").alias("pos", "value")).select("vec_id", "pos", F.col("value").cast("double").alias("value"))


@query
def col_list_lengths(spark: SparkSession, d: str) -> DataFrame:
    return assembly.split_lists(table(spark, d, "embeddings"), "vec_id", "embedding")[0]


@query
def col_list_slices(spark: SparkSession, d: str) -> DataFrame:
    """Concatenated children cut by lengths: each order's lines as one list out of its customer's."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "v"))).alias("x"))
    flat = per.select("o_custkey", F.flatten(F.transform("x", lambda e: e["v"])).alias("values"), F.transform("x", lambda e: F.size(e["v"])).alias("lengths"))
    return assembly.slice_lists(flat, "o_custkey", "values", "lengths").select("o_custkey", "ordinal", F.size("items").alias("n"), F.aggregate("items", F.lit(0), lambda a, x: a + x).alias("total"))


@query
def col_maps(spark: SparkSession, d: str) -> DataFrame:
    """Lists of pairs shredded and assembled; null and repeated keys stay."""
    pair = F.struct(F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise(F.substring("n_name", 1, 1)).alias("key"), F.col("n_nationkey").alias("value"))
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", pair.alias("p")))), lambda x: x["p"]).alias("m"))
    lengths = n.select("n_regionkey", F.size("m").alias("length"))
    again = assembly.join_maps(lengths, assembly.split_maps(n, "n_regionkey", "m"), "n_regionkey")
    return again.select("n_regionkey", F.posexplode("items").alias("pos", "e")).select("n_regionkey", "pos", F.col("e.key").alias("map_key"), F.col("e.value").alias("map_value"))


@query
def col_unions(spark: SparkSession, d: str) -> DataFrame:
    """A union as tags and dense variants, assembled again."""
    u = _union(spark, d)
    tags, values = assembly.split_union(u, "u", ["v0", "v1"])
    again = assembly.join_union(tags, values)
    return again.join(u.select("chunk", "ordinal", "event_id"), ["chunk", "ordinal"]).select("event_id", F.col("tag").cast("int").alias("tag"), "v0", "v1")


@query
def col_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Decimals as mantissa and scale, and back."""
    r = table(spark, d, "row_records").where("c_dec is not null").select("record_id", assembly.split_decimal("c_dec", 4).alias("p"))
    r = r.select("record_id", F.col("p.unscaled").alias("u"), F.col("p.scale").alias("s"))
    return r.select("record_id", F.col("u").cast("bigint").alias("unscaled"), F.col("s").cast("int").alias("scale"), assembly.join_decimal("u", 4, 18).alias("back"))


@query
def col_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps unzipped into seconds and nanoseconds."""
    return table(spark, d, "row_records").where("c_ts is not null").select("record_id", F.col("c_ts.seconds").alias("seconds"), F.col("c_ts.nanos").alias("nanos"))


@query
def col_zip(spark: SparkSession, d: str) -> DataFrame:
    """Columns side by side until the shortest ends."""
    a = assembly.ordinals(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], F.expr("s_suppkey div 4096"))
    b = assembly.ordinals(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], F.expr("n_nationkey div 4096"))
    return assembly.zip_columns(a, b)


@query
def col_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every 10,000 rows as a chunk."""
    return _chunked_lineitem(spark, d, "l_quantity").groupBy("chunk").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_orderkey").alias("first_key"))


@query
def col_transpose(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors as columns."""
    return assembly.transpose(table(spark, d, "embeddings"), "vec_id", "embedding").select("pos", "k", F.col("value").cast("double").alias("value"))


@query
def col_transpose_jagged(spark: SparkSession, d: str) -> DataFrame:
    """Lists of differing lengths as columns; short ones are passed over."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    return assembly.transpose(rows, "l_orderkey", "v")


@query
def col_segments_back(spark: SparkSession, d: str) -> DataFrame:
    """Pieces cut out of one buffer by offset and length: each chunk's event types end to end, and apart again."""
    it = _chunked_events(spark, d, "event_type").select("chunk", "ordinal", F.coalesce("event_type", F.lit("")).alias("piece"))
    cut = F.struct("ordinal", "piece", F.octet_length("piece").alias("length"))
    buffers = it.groupBy("chunk").agg(F.array_sort(F.collect_list(cut)).alias("x"))
    laid = buffers.select("chunk", F.array_join(F.transform("x", lambda e: e["piece"]), "").cast("binary").alias("buffer"), F.posexplode("x").alias("k", "e"))
    own = Window.partitionBy("chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("offset", F.coalesce(F.sum("e.length").over(own), F.lit(0)))
    return laid.select("e.ordinal", F.decode(assembly.cut_segments(F.col("buffer"), F.col("offset"), F.col("e.length")), "UTF-8").alias("event_type"))


@query
def col_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of text checked value by value against a schema; every seventh has a word where a number is due."""
    user = F.when(F.col("event_id") % 7 == 0, F.lit('"x"')).otherwise(F.col("user_id").cast("string"))
    rows = table(spark, d, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id": '), user, F.lit("}")).alias("text"))
    good, bad = orc.checked_rows(rows, "text", T.StructType.fromDDL("event_id bigint, user_id bigint"))
    return good.select("event_id", "user_id", F.lit(None).cast("string").alias("text")).unionByName(bad.select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), "text"))


@query
def col_segments(spark: SparkSession, d: str) -> DataFrame:
    """Texts laid end to end: offsets and lengths in bytes."""
    return assembly.segments(table(spark, d, "documents"), "doc_id", "text")


@query
def col_heads(spark: SparkSession, d: str) -> DataFrame:
    """First elements and rests."""
    e = table(spark, d, "embeddings").select("vec_id", assembly.safe_head(F.col("embedding")).cast("double").alias("head"), assembly.uncons(F.col("embedding")).alias("u"))
    return e.select("vec_id", "head", F.size("u.tail").alias("rest"))


@query
def set_append(spark: SparkSession, d: str) -> DataFrame:
    """Two whole tables of one shape."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    return columns.append(a, table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount")))


@query
def set_concat(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return columns.concat(spark, o.schema, [o.where(f"o_orderkey % 4 = {i}") for i in range(4)])


@query
def set_length(spark: SparkSession, d: str) -> DataFrame:
    return columns.length(table(spark, d, "lineitem"))


@query
def set_empty(spark: SparkSession, d: str) -> DataFrame:
    return columns.length(columns.empty_of(spark, table(spark, d, "orders").schema))


# ---- chunks of bytes


@query
def chunk_resize(spark: SparkSession, d: str) -> DataFrame:
    """All texts as one stream of bytes, cut every 65,536."""
    return chunking.resize_chunks(table(spark, d, "documents"), "doc_id", "text", 65_536).select("chunk", "n", F.md5(F.hex("body").cast("binary")).alias("digest"))


@query
def chunk_gather(spark: SparkSession, d: str) -> DataFrame:
    """A small table's column as one list on the driver, and its first ten."""
    n = table(spark, d, "nation")
    lists = [("all", chunking.gather(n, "n_name", ["n_nationkey"])), ("ten", chunking.gather(n, "n_name", ["n_nationkey"], 10))]
    return spark.createDataFrame([(k, len(v), "|".join(v)) for k, v in lists], "what string, n int, names string")


@query
def chunk_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(chunking.total_bytes("text").alias("n"))


@query
def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    """A stateful fold: each event's distance from the one before in its chunk, one line of text each."""
    emit = lambda last, row: (row["event_id"], f"{row['event_id'] - last if last else 0}\n".encode())
    it = chunking.fold_bytes(_chunked_events(spark, d).select("chunk", "event_id"), ["chunk"], ["event_id"], emit, lambda: None)
    return it.select("chunk", F.octet_length("body").cast("bigint").alias("n"))


@query
def chunk_map(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each element on its own."""
    it = chunking.map_bytes(table(spark, d, "events"), "event_id", "event_type", lambda s: s.upper().encode())
    return it.select("event_id", F.decode("body", "UTF-8").alias("upper_type"))


# ---- functions


@query
def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    """Day numbers to civil dates and back."""
    r = table(spark, d, "row_records").where("c_date is not null").select("record_id", F.unix_date("c_date").alias("day"))
    r = r.withColumn("c", civil.day_to_date("day"))
    return r.select("record_id", "day", "c.year", "c.month", F.col("c.day").alias("day_of_month"), civil.date_to_day(F.col("c.year"), F.col("c.month"), F.col("c.day")).alias("back"))


@query
def fn_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since 2015 to a date and the nanosecond of its day, and back."""
    r = table(spark, d, "row_records").where("c_ts is not null").select("record_id", civil.timestamp_to_datetime("c_ts.seconds", "c_ts.nanos").alias("t"))
    r = r.withColumn("b", civil.datetime_to_timestamp(F.col("t.date"), F.col("t.nano_of_day")))
    return r.select("record_id", "t.date", "t.nano_of_day", F.col("b.seconds").alias("seconds"), F.col("b.nanos").alias("nanos"))


@query
def fn_moments(spark: SparkSession, d: str) -> DataFrame:
    """Zone-less timestamps in the format's own counting."""
    e = table(spark, d, "events").select("event_id", civil.moment_to_timestamp("ts").alias("t"))
    return e.select("event_id", "t.seconds", "t.nanos")


@query
def fn_nanoseconds(spark: SparkSession, d: str) -> DataFrame:
    """The scaled form of nanoseconds and back."""
    r = table(spark, d, "row_records").where("c_ts is not null").select("record_id", F.col("c_ts.nanos").alias("nanos"))
    r = r.withColumn("code", civil.encode_nanoseconds("nanos"))
    return r.select("record_id", "nanos", "code", civil.decode_nanoseconds("code").alias("back"))


@query
def fn_zigzag(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "row_records").where("c_long is not null").select("record_id", F.col("c_long").alias("v"), "c_int")
    r = r.withColumn("code", bits.zigzag("v")).withColumn("small", bits.zigzag("c_int"))
    return r.select("record_id", "code", bits.unzigzag("code").alias("back"), "small", bits.zigzag("c_int", signed=False).alias("plain"), bits.zigzag_wide("v").cast("decimal(38,0)").alias("wide"))


@query
def fn_widths(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(32).select(F.col("id").cast("int").alias("code"), bits.bit_width("id").alias("width"))


@query
def fn_words24(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", bits.word24_le_bytes(F.col("o_orderkey") % 16_777_216).alias("b"))
    return o.select("o_orderkey", F.hex("b").alias("bytes"), bits.word24_le("b").alias("back"))


@query
def fn_big_endian(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0")).alias("b"))
    return o.select("o_orderkey", bits.big_endian("b", 4, signed=False).alias("plain"), bits.big_endian("b", 4).alias("zigzagged"), bits.sign_magnitude("b", 4).alias("magnitude"))


@query
def fn_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes shown unsigned."""
    r = table(spark, d, "row_records").where("c_byte is not null")
    signed = F.expr("cast(case when (c_byte & 255S) > 127 then (c_byte & 255S) - 256 else c_byte & 255S end as tinyint)")
    return r.select("record_id", bits.unsigned_byte(signed).cast("int").alias("byte"))


# ---- JSON text


@query
def json_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows through a file and out as JSON lines."""
    return jsontext.json_rows(orc.scan(spark, _stored(spread(table(spark, d, "lineitem"), "l_orderkey"), "json")))


@query
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with their escapes, and nulls."""
    return jsontext.json_rows(table(spark, d, "documents").select("doc_id", "text", "lang", "n_claims"))


@query
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Booleans, unsigned bytes, dates, decimals, nanosecond timestamps and binary."""
    r = table(spark, d, "row_records")
    ts = F.col("c_ts").alias("c_ts", metadata={jsontext.KIND: "timestamp"})
    return jsontext.json_rows(r.select("record_id", "c_bool", F.col("c_byte").alias("c_byte", metadata={jsontext.KIND: "byte"}), "c_date", "c_dec", ts, F.col("c_char").cast("binary").alias("c_bin")))


@query
def json_nested(spark: SparkSession, d: str) -> DataFrame:
    """Lists, maps as lists of pairs, structs and unions."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    tag = (F.col("n_regionkey") % 2).cast("smallint")
    union = F.struct(tag.alias("tag"), F.when(tag == 0, F.col("n_regionkey")).alias("v0"), F.when(tag == 1, F.lit("odd")).alias("v1")).alias("u", metadata={jsontext.KIND: "union"})
    names = F.map_from_entries(F.transform("nations", lambda x: F.struct(x["n_name"], x["n_nationkey"]))).alias("m")
    return jsontext.json_rows(n.select("n_regionkey", "nations", names, union))


@query
def json_roots(spark: SparkSession, d: str) -> DataFrame:
    """A root that isn't a struct."""
    return jsontext.json_rows(orc.as_root(table(spark, d, "region"), "r_name"))


# ---- encodings


@query
def enc_dictionary_choice(spark: SparkSession, d: str) -> DataFrame:
    return encodings.dictionary_decision(_chunked_events(spark, d, "props"), "props")


@query
def enc_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary ids in order of first appearance, and the values looked up again."""
    it = _chunked_events(spark, d, "event_type")
    ids, entries = encodings.dictionary_encode(it, "event_type"), encodings.dictionary(it, "event_type")
    back = encodings.dictionary_decode(ids, entries)
    return ids.join(back, ["chunk", "ordinal"]).select("ordinal", "id", F.col("value").alias("event_type"))


@query
def enc_tags(spark: SparkSession, d: str) -> DataFrame:
    return encodings.tag_counts(_union(spark, d).select("chunk", "u.tag"), "tag").select("chunk", F.col("tag").cast("int").alias("tag"), "n")


@query
def enc_equal_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one value in each stripe."""
    return encodings.equal_runs(_chunked_lineitem(spark, d, "l_returnflag"), "l_returnflag").select("chunk", "start", "length", "value")


@query
def enc_step_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches with a constant step in each stripe."""
    return encodings.step_runs(_chunked_lineitem(spark, d), "l_linenumber")


@query
def enc_expand(spark: SparkSession, d: str) -> DataFrame:
    """Stretches expanded to values again."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 3).alias("n"), (F.col("o_custkey") % 5 - 2).alias("step"))
    return encodings.expand_runs(o, "o_orderkey", "n", "o_orderkey", "step")


@query
def enc_repeats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", encodings.short_repeat(F.col("o_custkey"), (F.col("o_orderkey") % 12).cast("int")).alias("v"))
    return o.select("o_orderkey", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")).where("n > 0")


@query
def enc_bits(spark: SparkSession, d: str) -> DataFrame:
    """Booleans in bytes, high bit first."""
    it = _chunked_events(spark, d, "event_type").withColumn("b", F.col("event_type") == "click")
    return encodings.pack_bits(it, "b")


@query
def enc_bits_back(spark: SparkSession, d: str) -> DataFrame:
    it = _chunked_events(spark, d, "event_type").withColumn("b", F.col("event_type") == "click")
    return encodings.unpack_bits(encodings.pack_bits(it, "b")).groupBy("chunk").agg(F.count_if("bit").alias("n"), F.sum(F.when(F.col("bit"), F.col("place")).otherwise(0)).alias("places"))


@query
def enc_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas in each stripe, and the values they give."""
    it = encodings.deltas(_chunked_lineitem(spark, d, "l_partkey"), "l_partkey")
    return it.join(encodings.undo_deltas(it), ["chunk", "ordinal"])


@query
def enc_varint_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(encodings.varint_length(F.col("l_partkey")).alias("bytes")).agg(F.count("*").alias("n"))


def _codec(name: str, column: str, item: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        it = _chunked_lineitem(spark, d, *({column} - {"l_linenumber"}))
        arrays = it.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", column))), lambda x: x[column]).alias("items"))
        back = codecs.decode_chunks(codecs.encode_chunks(arrays, name), name, item)
        return back.select("chunk", F.posexplode("items").alias("pos", "value")).select((F.col("chunk") * orc.STRIPE_ROWS + F.col("pos")).alias("ordinal"), "value")

    run.__name__, run.__doc__ = f"enc_bytes_{name}", f"Each stripe's {column} as bytes by the codec {name}, and decoded again."
    query(run)


for _name, _column, _item in (("varint", "l_partkey", "bigint"), ("runs", "l_linenumber", "bigint"), ("bytes", "l_linenumber", "bigint"), ("double", "l_extendedprice", "double"), ("float", "l_quantity", "float")):
    _codec(_name, _column, _item)


@query
def enc_coded_varint(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each stripe's part keys, zigzag and seven bits to a byte: how many, and their digest."""
    it = _chunked_lineitem(spark, d, "l_partkey")
    arrays = it.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "l_partkey"))), lambda x: x["l_partkey"]).alias("items"))
    coded = codecs.encode_chunks(arrays, "varint")
    return coded.select("chunk", F.octet_length("body").cast("bigint").alias("bytes"), F.md5(F.hex("body").cast("binary")).alias("digest"))


@query
def enc_bytes_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many bytes each stripe's line numbers take by each codec."""
    it = _chunked_lineitem(spark, d)
    arrays = it.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "l_linenumber"))), lambda x: x["l_linenumber"]).alias("items"))
    out = None
    for name in ("varint", "runs", "bytes"):
        one = codecs.encode_chunks(arrays, name).select("chunk", F.lit(name).alias("codec"), "n", F.octet_length("body").cast("bigint").alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- consumers and streams


@query
def stream_observed(spark: SparkSession, d: str) -> DataFrame:
    """A table written to a file and counted beside it, in one pass."""
    from lamella.streaming import orc_stream

    df, figures = orc_stream.observed(table(spark, d, "events"), "teed", n=F.count("*"), clicks=F.count_if(F.col("event_type") == "click"), total=F.sum("user_id"))
    path = _stored(df, "teed", "zlib")
    seen = figures()
    return orc.scan(spark, path).agg(F.count("*").alias("written")).withColumns({k: F.lit(seen[k]).cast("bigint") for k in ("n", "clicks", "total")})


@query
def udf_stripes(spark: SparkSession, d: str) -> DataFrame:
    """A consumer over Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.multiply(b.column(1), 2.0)], names=["event_id", "doubled"])

    return table(spark, d, "events").select("event_id", "value").mapInArrow(run, "event_id bigint, doubled double")


@query
def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files read as a stream and written to another, each row once."""
    from lamella.streaming import orc_stream

    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    source, target = _stored(df, "stream-in", "zlib"), fresh_path(spark, "stream-out")
    orc_stream.write_stream(orc_stream.read_stream(spark, source, df.schema), target, fresh_path(spark, "stream-state"), "zlib").awaitTermination()
    return spark.read.schema(df.schema).orc(target)


