"""Files of a folder as an unbounded stream, and a stateful fold over ordered chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lamella.sources.orc import codec


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New ORC files of a folder as they arrive; earlier files are let go once their batch is done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).orc(folder)


def write_stream(df: DataFrame, folder: str, checkpoint: str, compression: str | None = None):
    """Appends a stream to a folder of ORC files, each row once; runs over what is there and ends."""
    return df.writeStream.format("orc").option("path", folder).option("checkpointLocation", checkpoint).option("compression", codec(compression)).outputMode("append").trigger(availableNow=True).start()


def observed(df: DataFrame, what: str, **figures) -> tuple[DataFrame, Callable[[], dict]]:
    """(df, its figures): aggregates that are worked out while df goes elsewhere, as when a stream of values is teed into a counter. df may be a stream.

    The figures are there once an action on df has ended; until then asking waits. Of a stream, its query's progress holds them under `what`.
    """
    from pyspark.sql import Observation

    columns = [c.alias(n) for n, c in figures.items()]
    if df.isStreaming:
        return df.observe(what, *columns), lambda: {}
    seen = Observation(what)
    return df.observe(seen, *columns), lambda: seen.get


def running_lengths(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, chunks, bytes so far of each key in each batch: state is kept by Spark, so it survives a lost executor and a restart.

    df must be a stream; null values count as empty chunks, null keys form one group.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunks, size = state.get if state.exists else (0, 0)
        for part in parts:
            chunks += len(part)
            size += int(sum(len(x) if x is not None else 0 for x in part["chunk"]))
        state.update((chunks, size))
        yield pd.DataFrame({"key": [None if pd.isna(group[0]) else str(group[0])], "chunks": [chunks], "bytes": [size]})

    shaped = df.selectExpr(f"cast(`{key}` as string) as key", f"cast(`{value}` as binary) as chunk")
    return shaped.groupBy("key").applyInPandasWithState(fold, "key string, chunks bigint, bytes bigint", "chunks bigint, bytes bigint", "update", GroupStateTimeout.NoTimeout)
