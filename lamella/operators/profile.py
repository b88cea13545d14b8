"""A data quality profile of every column of every load, from value counts that are kept and updated by signed deltas.

Method. A table of (load, column, value, count) is kept in the shared folder; a delivery adds its values with +1, a later delivery of the same record takes
the former one's values back with -1, as does taking back a whole load, and values whose counts come to nothing vanish. Every figure (counts, nulls, distinct
values, range and pattern violations, medians, entropy) is exact and comes from the kept counts, not from the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.ordered import split_lag
from lamella.operators.registry import registered_files
from lamella.session import fresh_path, written

#: The profiled columns and the slot that keeps their values exactly: l whole numbers, d binary fractions, n decimals, s text.
COLUMNS = {
    "c_bool": "l", "c_byte": "l", "c_short": "l", "c_int": "l", "c_long": "l", "c_float": "d", "c_double": "d", "c_dec": "n", "c_date": "l", "c_str": "s", "c_varchar": "s", "c_char": "s",
}
SLOTS = {"l": "bigint", "d": "double", "n": "decimal(18,4)", "s": "string"}
#: Stated ranges and the stated form: fixed values. Dates count as days since 1970-01-01.
RANGES = {"c_byte": (0, 255), "c_double": (-1e6, 1e6), "c_date": (-25_567, 47_481)}
PATTERN = ("c_varchar", r"^[A-Z]{3}-[0-9]{5}$")
#: Columns whose medians are compared between loads.
CENTRED = ("c_int", "c_double")
#: Rows of a load in one task; a larger load is counted in pieces.
PIECE_ROWS = 500_000


def _number(name: str) -> int:
    return list(COLUMNS).index(name)


def large_loads(row_records: DataFrame, rows: int | None = None) -> DataFrame:
    """file_id, pieces of the loads with more than `rows` rows (PIECE_ROWS)."""
    rows = rows or PIECE_ROWS
    return row_records.where("file_id is not null").groupBy("file_id").agg(F.expr(f"cast(ceil(count(*) / {rows}) as int)").alias("pieces")).where("pieces > 1")


def deltas(row_records: DataFrame, names: list[str], large: DataFrame | None = None) -> DataFrame:
    """Signed single values: file_id, piece, c (column number), l, d, n, s, delta.

    Every delivery gives +1 for each of its values, and -1 if a later one replaces it, so that the last stands; of equal times the greater hash is the last.
    Rows without record_id are never replaced. One shuffle brings a load together, the loads of `large` (see large_loads) by load and a share of their
    record_ids; piece is null for the others. To take a load back, negate its deltas. To bring a later delivery into counts that are kept, pass the rows
    that it replaces along with it and take theirs back.
    """
    kept = [n for n in COLUMNS if n in names]
    rows = row_records.where("file_id is not null").select("file_id", "record_id", "ingested_at", *kept)
    if large is None:
        rows = rows.withColumn("piece", F.lit(None).cast("int"))
    else:
        rows = rows.join(large, "file_id", "left").withColumn("piece", F.expr("cast(pmod(xxhash64(record_id), pieces) as int)")).drop("pieces")
    rows = rows.repartition("file_id", "piece")
    turn = Window.partitionBy("file_id", "piece", "record_id").orderBy("ingested_at", F.xxhash64(*kept))
    replaced = F.lead(F.lit(True)).over(turn).isNotNull() & F.col("record_id").isNotNull()
    signs = F.when(replaced, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))).cast("array<bigint>")
    rows = rows.withColumn("signs", signs).withColumn("delta", F.explode("signs"))

    def packed(name: str) -> Column:
        slot = COLUMNS[name]
        value = F.unix_date(name) if name == "c_date" else F.col(name)
        return F.struct(F.lit(_number(name)).cast("tinyint").alias("c"), *[(value if s == slot else F.lit(None)).cast(t).alias(s) for s, t in SLOTS.items()])

    return rows.select("file_id", "piece", "delta", F.explode(F.array(*map(packed, kept))).alias("v")).select("file_id", "piece", "v.*", "delta")


def value_counts(signed: DataFrame) -> DataFrame:
    """file_id, piece, c, l, d, n, s, count: the sum of the deltas of each value; values whose deltas cancel vanish."""
    return signed.groupBy("file_id", "piece", "c", *SLOTS).agg(F.sum("delta").alias("count")).where("count <> 0")


class ValueCounts:
    """A value-count table kept in a folder: a batch of signed deltas of any loads is applied as a part of its own, and reading sums the parts up.

    Applying a batch twice is prevented by its name: one already there is left alone.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "value-counts")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")

    def batches(self) -> list[str]:
        """The batches that are wholly there."""
        if not self.fs.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path(""))]
        return sorted(n for n in names if self.fs.exists(self._path(f"{n}/_SUCCESS")))

    def apply(self, batch: str, signed: DataFrame) -> None:
        if batch not in self.batches():
            value_counts(signed).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{batch}")

    def counts(self) -> DataFrame:
        """file_id, c, l, d, n, s, count. What one batch has in one piece needs no summing up."""
        there = self.batches()
        stored = self.spark.read.parquet(*[f"{self.path}/{x}" for x in there])
        key = ["file_id", "c", *SLOTS]
        summed = lambda df: df.groupBy(*key).agg(F.sum("count").alias("count")).where("count <> 0")
        if len(there) > 1:
            return summed(stored)
        return stored.where("piece is null").select(*key, "count").unionByName(summed(stored.where("piece is not null")))


def measures(counts: DataFrame) -> DataFrame:
    """file_id, c, rows, n (non-null values), distinct, out_of_range, off_pattern, entropy (bits, over the non-null values)."""
    there = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("n").isNotNull() | F.col("s").isNotNull()
    bad = F.lit(False)
    for name, (lo, hi) in RANGES.items():
        x = F.col(COLUMNS[name])
        bad = bad | ((F.col("c") == _number(name)) & x.isNotNull() & ~((x >= lo) & (x <= hi)))
    odd = (F.col("c") == _number(PATTERN[0])) & F.col("s").isNotNull() & ~F.col("s").rlike(PATTERN[1].replace("$", r"\z"))
    k = F.col("count")
    out = counts.groupBy("file_id", "c").agg(
        F.sum(k).alias("rows"),
        F.sum(F.when(there, k).otherwise(0)).alias("n"),
        F.sum(F.when(there, 1).otherwise(0)).cast("bigint").alias("distinct"),
        F.sum(F.when(bad, k).otherwise(0)).alias("out_of_range"),
        F.sum(F.when(odd, k).otherwise(0)).alias("off_pattern"),
        F.sum(F.when(there, k * F.log2(k)).otherwise(0.0)).alias("_klogk"),
    )
    entropy = F.when(F.col("n") > 0, F.log2("n") - F.col("_klogk") / F.col("n"))
    return out.select("file_id", "c", "rows", "n", "distinct", "out_of_range", "off_pattern", entropy.alias("entropy"))


def medians(counts: DataFrame) -> DataFrame:
    """file_id, c, median of the CENTRED columns of loads of any size; NaN counts as the greatest value.

    Counts by coarse bucket find the buckets of the middle ranks, and only their values are ranked. Buckets follow the value's logarithm, 256 to a doubling,
    so a load has at most some 530,000 of them.
    """
    v = F.coalesce(F.col("d"), F.col("l").cast("double"))
    finite = F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 256)
    bucket = F.when(F.isnan("v"), F.lit((1 << 63) - 1)).when(F.col("v") == math.inf, F.lit((1 << 63) - 2)).when(F.col("v") == -math.inf, F.lit(-(1 << 63))).otherwise(finite)
    values = counts.where(F.col("c").isin([_number(n) for n in CENTRED])).select("file_id", "c", v.alias("v"), "count").where("v is not null").withColumn("bucket", bucket.cast("bigint"))
    key = Window.partitionBy("file_id", "c")
    before = key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy("file_id", "c", "bucket").agg(F.sum("count").alias("k"))
    sums = sums.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("n", F.sum("k").over(key))
    lo, hi = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    sums = sums.where(((lo > F.col("before")) & (lo <= F.col("before") + F.col("k"))) | ((hi > F.col("before")) & (hi <= F.col("before") + F.col("k"))))
    near = values.join(sums.select("file_id", "c", "bucket", "before", "n"), ["file_id", "c", "bucket"])
    inside = Window.partitionBy("file_id", "c", "bucket").orderBy("v")
    near = near.withColumn("upto", F.col("before") + F.sum("count").over(inside))
    hit = lambda r: (r > F.col("upto") - F.col("count")) & (r <= F.col("upto"))
    return near.groupBy("file_id", "c").agg(((F.max(F.when(hit(lo), F.col("v"))) + F.max(F.when(hit(hi), F.col("v")))) / 2).alias("median"))


def figures(counts: DataFrame) -> DataFrame:
    """file_id, c, rows, n, distinct, out_of_range, off_pattern, entropy, median of every column of every load in the counts."""
    return measures(counts).join(medians(counts), ["file_id", "c"], "left")


def profile(row_records: DataFrame) -> DataFrame:
    """The figures of every column of every load that has rows, from value counts kept in the shared folder.

    Each record counts once, with its latest delivery. NaN counts as a value, outside every range.
    """
    kept = ValueCounts(row_records.sparkSession)
    large = written(large_loads(row_records), "large-loads")  # its size is known to the join
    kept.apply("deliveries", deltas(row_records, list(COLUMNS), large))
    return figures(kept.counts())


@dataclass
class Limits:
    """When a figure is out of order: fixed by the statement of the problem."""

    constant_from: int = 30
    rows_from: int = 40
    null_step: float = 0.3
    median_factor: float = 3.0


def issues(row_records: DataFrame, orc_files: DataFrame, column_stats: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """file_id, column_name, issue: which columns of which flat files are out of order, alone or against the load before.

    Repeated statements collapse; of statements that differ the larger counts. A file without rows has 0 values and no nulls and is no load before.
    Null feeds form one feed. Columns of column_stats beyond the twelve are left out.
    """
    files = registered_files(orc_files).where("file_layout = 'flat'").select("file_id", "feed_id", "written_at")
    seen = written(profile(row_records), "profile")  # twelve rows for each load, read three times below
    numbered = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("c"), F.lit(n).alias("column_name")) for i, n in enumerate(COLUMNS)]))
    loads = files.join(seen.where("c = 0").select("file_id"), "file_id", "left_semi")
    order = split_lag(loads, ["feed_id"], ["written_at", "file_id"], F.coalesce(F.to_date("written_at"), F.lit("0001-01-01").cast("date")), {"before": "file_id"})
    past = seen.select(F.col("file_id").alias("before"), "c", F.col("rows").alias("rows_0"), F.col("n").alias("n_0"), F.col("median").alias("median_0"))
    now = seen.join(order.select("file_id", "before"), "file_id").join(past, ["before", "c"], "left")
    stated = column_stats.where("file_id is not null").groupBy("file_id", "column_name").agg(F.max("number_of_values").alias("stated_n"), F.max("has_null").alias("stated_null"))
    every = files.select("file_id", numbered.alias("x")).select("file_id", "x.*").join(now, ["file_id", "c"], "left").join(stated, ["file_id", "column_name"], "left")
    n, rows = F.coalesce("n", F.lit(0)), F.coalesce("rows", F.lit(0))
    both = (F.col("rows") >= limits.rows_from) & (F.col("rows_0") >= limits.rows_from)
    rate = lambda a, b: (F.col(b) - F.col(a)) / F.col(b)
    hi, lo = F.greatest("median", "median_0"), F.least("median", "median_0")
    tests = {
        "count": F.col("stated_n").isNotNull() & (F.col("stated_n") != n),
        "flag": F.col("stated_null").isNotNull() & (F.col("stated_null") != (rows > n)),
        "range": F.col("out_of_range") > 0,
        "pattern": F.col("off_pattern") > 0,
        "distinct": (F.col("column_name") != "c_bool") & (n >= limits.constant_from) & (F.col("distinct") == 1),
        "nulls": both & (F.abs(rate("n", "rows") - rate("n_0", "rows_0")) > limits.null_step),
        "shift": (F.col("n") >= limits.rows_from) & (F.col("n_0") >= limits.rows_from) & (hi > limits.median_factor * lo),
    }
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return every.select("file_id", "column_name", F.explode(named).alias("issue"))
