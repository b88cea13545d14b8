"""The registered queries of the core: each takes (spark, folder) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import compaction, drift, instants, profile, shredding
from lamella.plans import reference
from lamella.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change between a file's schema and that of the file before it in its feed."""
    return drift.schema_changes(table(spark, d, "orc_files"), table(spark, d, "file_types")).select("file_id", "change_kind", "field_path")


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of column lifespans, one row per unbroken island of versions."""
    return drift.lifespans(table(spark, d, "orc_files"), table(spark, d, "file_types"))


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    """The casts that bring every field of a feed under one name and kind."""
    return drift.cast_plan(table(spark, d, "orc_files"), table(spark, d, "file_types")).withColumn("kinds", F.array_join("kinds", "|"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All flat and nested rows in one consistent table, a row per field, cast to the field's kind."""
    return drift.unified_fields(table(spark, d, "orc_files"), table(spark, d, "file_types"), table(spark, d, "nested_rows"), table(spark, d, "row_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child row of the nested payloads with its parent, rebuilt from levels."""
    return shredding.children(table(spark, d, "nested_rows"), table(spark, d, "file_types"))


def p2_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaf columns with their repetition and definition levels."""
    return shredding.leaf_values(shredding.shredded(table(spark, d, "nested_rows"), table(spark, d, "file_types")))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The related flat tables: every record and child row with its values and its parent."""
    it = shredding.flat_tables(table(spark, d, "nested_rows"), table(spark, d, "file_types"))
    return it.withColumn("columns", F.to_json("columns"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Columns of loads that are out of order."""
    return profile.issues(table(spark, d, "row_records"), table(spark, d, "orc_files"), table(spark, d, "column_stats"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """The exact profile of every column of every load."""
    names = F.array(*map(F.lit, profile.COLUMNS))
    seen = profile.profile(table(spark, d, "row_records"))
    return seen.select("file_id", F.element_at(names, F.col("c").cast("int") + 1).alias("column_name"), "rows", "n", "distinct", "out_of_range", "off_pattern", F.round("entropy", 6).alias("entropy"), F.round("median", 6).alias("median"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The small files that stand in a joined file: planned, joined frame by frame, and found intact."""
    plan = compaction.compaction_plan(table(spark, d, "orc_files"), table(spark, d, "stripes"))
    return compaction.joined_files(plan, table(spark, d, "row_records"), table(spark, d, "nested_rows")).where("intact").select("file_id")


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """What the joined files hold, the small ones being newline-delimited: one row per container."""
    plan = compaction.compaction_plan(table(spark, d, "orc_files"), table(spark, d, "stripes"))
    each = compaction.joined_files(plan, table(spark, d, "row_records"), table(spark, d, "nested_rows"), "lines")
    return each.groupBy("container_id").agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.expr("max(container_bytes) = sum(bytes) + count_if(records > 0) and every(intact)").alias("intact"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC moment of every record that states one."""
    return instants.instants(table(spark, d, "row_records"), table(spark, d, "stripes"), table(spark, d, "orc_files"))


QUERIES: dict[str, Query] = reference.QUERIES | {
    f.__name__: f for f in (p1_found, p1_lifespans, p1_casts, p1_unified, p2_found, p2_leaves, p2_tables, p3_found, p3_profile, p4_found, p4_joined, p5_found)
}
#: Rows through a file and out as JSON lines.
FLAGSHIP = "json_lineitem"
