"""Byte streams in chunks of one size, their totals, and folds over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.ordered import split_sum


def resize_chunks(pieces: DataFrame, order: str, piece: str, size: int, block: int = 4096) -> DataFrame:
    """Pieces laid end to end and cut anew: (chunk, body binary, n): every chunk has exactly `size` bytes but the last, which may be shorter.

    No byte is lost or moved. A piece is cut where it stands, so nothing larger than a chunk or a piece is ever in one task. Null and empty pieces give
    nothing; a size below 1 raises ValueError. order: a whole number, unique.
    """
    if size < 1:
        raise ValueError("a chunk holds at least one byte")
    body = F.col(piece).cast("binary")
    laid = split_sum(pieces.select(order, body.alias("_body")).withColumn("_n", F.octet_length("_body").cast("bigint")).where("_n > 0"), [], [order], F.expr(f"`{order}` div {block}"), "_n", "_at")
    first, last = F.expr(f"_at div {size}"), F.expr(f"(_at + _n - 1) div {size}")
    cut = laid.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * size, F.col("_at"))
    end = F.least((F.col("chunk") + 1) * size, F.col("_at") + F.col("_n"))
    parts = cut.select("chunk", begin.alias("_begin"), F.substring("_body", (begin - F.col("_at") + 1).cast("int"), (end - begin).cast("int")).alias("_part"))
    joined = parts.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_begin", "_part"))), lambda x: F.hex(x["_part"])).alias("_all"))
    return joined.select("chunk", F.unhex(F.array_join("_all", "")).alias("body")).withColumn("n", F.octet_length("body").cast("bigint"))


def total_bytes(column: str) -> Column:
    """The bytes of a column, as an aggregate; `df.observe` gives it along with another action."""
    return F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("bigint")


def fold_bytes(df: DataFrame, keys: list[str], order: list[str], emit: Callable[[object, dict], tuple[object, bytes]], start: Callable[[], object]) -> DataFrame:
    """A stateful fold that emits bytes for each row: (keys…, body). Groups must fit a task: fold a stripe's rows, not a table.

    emit(state, row) gives the next state and the bytes; it is called in order within a group.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        state, out = start(), []
        for row in part.to_dict("records"):
            state, body = emit(state, row)
            out.append(body)
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "body": [b"".join(out)]})

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, body binary")


def map_bytes(df: DataFrame, key: str, column: str, emit: Callable[[object], bytes]) -> DataFrame:
    """Bytes for each element on its own: (key, body). Null values give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "body": [None if v is None else emit(v) for v in part[column]]})

    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, body binary")


def gather(df: DataFrame, column: str, order: list[str], limit: int | None = None) -> list:
    """A column as a list on the driver, in order; with a limit, no more than so many. For small results only: without a limit the whole column comes."""
    rows = df.orderBy(*order).select(column)
    return [r[0] for r in (rows.limit(limit) if limit is not None else rows).toLocalIterator()]
