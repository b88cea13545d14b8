"""Columns taken apart and put together: presence, lists, maps, unions, segments, chunks and transposition.

Order is carried by an explicit ordinal. Windows never run over a whole table: they are partitioned by a chunk, which a stripe's size bounds, or go
through split_sum, which carries sums from one block of ordinals to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.ordered import split_sum


def ordinals(df: DataFrame, order: list[str], bucket: Column, name: str = "ordinal") -> DataFrame:
    """df with the number of rows before each row by `order`, from 0. The bucket follows the order, and one bucket must fit in a task."""
    return split_sum(df.withColumn("_one", F.lit(1)), [], order, bucket, "_one", name).drop("_one")


def chunked(df: DataFrame, order: list[str], bucket: Column, size: int) -> DataFrame:
    """df with `ordinal` and `chunk`: every `size` rows in order make a chunk, the last may be shorter. A size below 1 raises ValueError."""
    if size < 1:
        raise ValueError("a chunk holds at least one row")
    return ordinals(df, order, bucket).withColumn("chunk", F.expr(f"ordinal div {size}"))


def split_presence(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df(chunk, ordinal, column) as presence(chunk, ordinal, present) and packed(chunk, rank, value): only present values, numbered within their chunk.

    A chunk without nulls needs no presence; that is for the caller to see from the counts.
    """
    there = F.col(column).isNotNull()
    w = Window.partitionBy("chunk").orderBy("ordinal")
    presence = df.select("chunk", "ordinal", there.alias("present"))
    packed = df.where(there).select("chunk", (F.row_number().over(w) - 1).cast("bigint").alias("rank"), F.col(column).alias("value"))
    return presence, packed


def merge_presence(presence: DataFrame, packed: DataFrame) -> DataFrame:
    """The inverse: (chunk, ordinal, value), null where absent."""
    w = Window.partitionBy("chunk").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ranked = presence.withColumn("rank", F.when(F.col("present"), F.coalesce(F.count_if("present").over(w), F.lit(0))))
    return ranked.join(packed, ["chunk", "rank"], "left").select("chunk", "ordinal", "value")


def zip_columns(*columns: DataFrame) -> DataFrame:
    """Columns (ordinal, …) side by side; as the shortest ends, so does the result."""
    out = columns[0]
    for c in columns[1:]:
        out = out.join(c, "ordinal")
    return out


def split_lists(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Lists as lengths(key, length) and children(key, pos, value). A null list has a null length, an empty one 0; neither has children."""
    lengths = df.select(key, F.when(F.col(column).isNotNull(), F.size(column)).alias("length"))
    return lengths, df.select(key, F.posexplode(column).alias("pos", "value"))


def join_lists(lengths: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The inverse: (key, items), in order of pos. One list fits in a row, before and after."""
    lists = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_items"))
    full = lengths.join(lists, key, "left")
    kind = full.schema["_items"].dataType.simpleString()
    return full.select(key, F.when(F.col("length").isNull(), F.lit(None)).when(F.col("length") == 0, F.array().cast(kind)).otherwise(F.col("_items")).alias("items"))


def slice_lists(flat: DataFrame, chunk: str, values: str, lengths: str) -> DataFrame:
    """Chunks of concatenated children, cut by lengths: (chunk, items): one row per list. flat holds arrays of values and of lengths."""
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    cut = F.transform(F.arrays_zip(F.col(lengths).alias("n"), ends.alias("e")), lambda x: F.slice(F.col(values), x["e"] - x["n"] + 1, x["n"]))
    return flat.select(chunk, F.posexplode(cut).alias("ordinal", "items"))


def split_maps(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lists of pairs as entries(key, pos, map_key, map_value); null and repeated keys are kept."""
    return df.select(key, F.posexplode(column).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("map_key"), F.col("e.value").alias("map_value"))


def join_maps(lengths: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    return join_lists(lengths, entries.select(key, "pos", F.struct(F.col("map_key").alias("key"), F.col("map_value").alias("value")).alias("value")), key)


def split_union(df: DataFrame, column: str, variants: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """df(chunk, ordinal, union) as tags(chunk, ordinal, tag) and, for each variant, its values densely numbered: (chunk, rank, value).

    A tag outside the variants makes the query fail, rather than be lost.
    """
    tag = F.col(column)["tag"]
    known = F.when(tag.isNull() | tag.between(0, len(variants) - 1), tag).otherwise(F.raise_error(F.concat(F.lit("no variant "), tag.cast("string"))).cast("smallint"))
    tags = df.select("chunk", "ordinal", known.alias("tag"))
    w = Window.partitionBy("chunk").orderBy("ordinal")
    return tags, [df.where(tag == i).select("chunk", (F.row_number().over(w) - 1).cast("bigint").alias("rank"), F.col(column)[v].alias("value")) for i, v in enumerate(variants)]


def join_union(tags: DataFrame, values: list[DataFrame]) -> DataFrame:
    """The inverse: (chunk, ordinal, tag, v0, v1, …): the next value of the tagged variant goes to each row."""
    w = Window.partitionBy("chunk", "tag").orderBy("ordinal")
    out = tags.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))
    for i, v in enumerate(values):
        out = out.join(v.select("chunk", "rank", F.lit(i).cast("smallint").alias("tag"), F.col("value").alias(f"v{i}")), ["chunk", "rank", "tag"], "left")
    return out.select("chunk", "ordinal", "tag", *[f"v{i}" for i in range(len(values))])


def split_decimal(column: str, scale: int) -> Column:
    """struct(unscaled, scale) of a decimal with a uniform scale; a scale beyond a signed byte raises ValueError."""
    if not -128 <= scale <= 127:
        raise ValueError("a scale fits in a signed byte")
    return F.struct((F.col(column) * F.lit(10**scale)).cast("decimal(38,0)").alias("unscaled"), F.lit(scale).cast("tinyint").alias("scale"))


def join_decimal(unscaled: str, scale: int, precision: int = 38) -> Column:
    return (F.col(unscaled).cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal({precision},{scale})")


def transpose(rows: DataFrame, order: str, values: str, block: int = 4096) -> DataFrame:
    """Rows of values as columns: (pos, k, value): the k-th value at position pos, over the rows in order that reach so far. Short rows are passed over.

    As a column is as long as the table, it comes out as rows, not as one array. order: a whole number, unique.
    """
    flat = rows.select(order, F.posexplode(values).alias("pos", "value")).withColumn("_one", F.lit(1))
    return split_sum(flat, ["pos"], [order], F.expr(f"`{order}` div {block}"), "_one", "k").select("pos", "k", "value")


def segments(pieces: DataFrame, order: str, piece: str, block: int = 4096) -> DataFrame:
    """Pieces laid end to end: (order, offset, length): offset counts the bytes of all pieces before. Null pieces have no length and take no room."""
    sized = pieces.select(order, F.octet_length(piece).cast("bigint").alias("length"))
    return split_sum(sized, [], [order], F.expr(f"`{order}` div {block}"), "length", "offset").select(order, "offset", "length")


def cut_segments(buffer: Column, offset: Column, size: Column) -> Column:
    """One piece of a buffer."""
    return F.substring(buffer, offset.cast("int") + 1, size.cast("int"))


def safe_head(items: Column) -> Column:
    """The first element, null for an empty list."""
    return F.try_element_at(items, F.lit(1))


def uncons(items: Column) -> Column:
    """struct(head, tail) of a list that isn't empty, else null."""
    return F.when(F.size(items) > 0, F.struct(F.element_at(items, 1).alias("head"), F.slice(items, F.lit(2), F.size(items)).alias("tail")))
