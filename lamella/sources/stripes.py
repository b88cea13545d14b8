"""ORC files read stripe by stripe, each row with its place."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.sources.files import opened
from lamella.sources.footer import footers

#: Bytes of stripes that one task reads, at least.
TASK_BYTES = 67_108_864


def _plain(column):
    """Timestamps in microseconds, and a union as struct(tag, v0, v1, …)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_timestamp(column.type):
        return pc.cast(column, pa.timestamp("us", tz=column.type.tz), safe=False)
    if pa.types.is_union(column.type):
        tags = column.type_codes.cast(pa.int16())
        fields = [tags]
        for i in range(column.type.num_fields):
            child = column.field(i)
            where = pc.equal(tags, i)
            at = column.offsets if column.type.mode == "dense" else pa.array(range(len(column)), pa.int32())
            fields.append(pc.if_else(where, child.take(pc.if_else(where, at, None)), pa.nulls(len(column), child.type)))
        return pa.StructArray.from_arrays(fields, names=["tag", *[f"v{i}" for i in range(len(fields) - 1)]])
    return column


def read_stripes(spark: SparkSession, path: str, schema: StructType | str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of the files below a path with _file, _stripe and _row: order within a file is (_stripe, _row).

    Only the columns of the schema are read (all, where it is None). The stripes are taken from the footers and spread over tasks of about task_bytes; the
    driver learns only how many bytes there are. Arrow's own reader is used, so files with unions can be opened too, a union as tag and variants.
    """
    if schema is None:
        schema = spark.read.orc(path).schema
    text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    whole = StructType.fromDDL(f"{text}, _file string, _stripe int, _row bigint")
    names = [f.name for f in whole.fields]
    found = footers(spark, path).where("error is null").select("file_path", F.explode("stripes").alias("s")).where("s.rows > 0")
    each = found.select("file_path", "s.stripe_no", (F.col("s.index_length") + F.col("s.data_length")).alias("bytes"))
    total = each.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(-(-total // task_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (task_bytes // 64))), 1)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.orc as orc

        now, file = None, None
        for batch in batches:
            for name, stripe in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if name != now:
                    system, local = opened(name)
                    now, file = name, orc.ORCFile(system.open_input_file(local))
                own = [c for c in names if c not in ("_file", "_stripe", "_row")]
                rows = file.read_stripe(stripe, columns=own)
                n = rows.num_rows
                place = {"_file": pa.array([name] * n, pa.string()), "_stripe": pa.array([stripe] * n, pa.int32()), "_row": pa.array(range(n), pa.int64())}
                yield pa.RecordBatch.from_arrays([place[c] if c in place else _plain(rows.column(rows.schema.get_field_index(c))) for c in names], names=names)

    return each.select("file_path", "stripe_no").repartition(tasks, "file_path", "stripe_no").mapInArrow(read, whole)
