"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import leakage, mojibake, packing
from lamella.tables import table


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of every target size."""
    return packing.packed_documents(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    targets = table(spark, d, "pack_targets")
    return packing.fill_report(packing.packed_documents(table(spark, d, "documents"), targets), targets).withColumn("unused", F.round("unused", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a held-out item in runs."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that comes near, with its scores and verdict."""
    return leakage.matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were decoded with a wrong encoding, wholly or in places."""
    return mojibake.damaged_ids(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The damaged documents with their text restored where possible."""
    return mojibake.damaged(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_packed, p6_fill, p7_found, p7_report, p8_found, p8_restored)}


def _leaks_sql() -> str:
    """Pairs in which at least half of an item's words stand under runs of six that the document has too."""
    tidy = "text"
    for what, by in (("[\u00ad\u200b-\u200d\u2060\ufeff]", ""), ("</?[A-Za-z][^<>]*>", " "), ("&[A-Za-z]+;", " "), ("[-‐][ \\t]*\\r?\\n\\s*", "")):
        tidy = f"regexp_replace({tidy}, '{what}', '{by}', 'g')"
    words = f"regexp_extract_all(lower(nfc_normalize({tidy})), '[\\p{{L}}\\p{{N}}]+')"
    runs = lambda of: f"select id, n, i, array_to_string(w[i:i + 5], ' ') as run from (select *, unnest(range(1, n - 4)) as i from (select *, len(w) as n from {of}))"
    return f"""with d as (select doc_id as id, {words} as w from documents where doc_id is not null and text is not null), e as (select item_id as id, {words} as w from eval_items where item_id is not null and text is not null),
        a as ({runs('e')}), b as (select distinct id, run from ({runs('d')}) where run in (select run from a)),
        c as (select distinct a.id as item_id, b.id as doc_id, n, unnest(range(i, i + 6)) as place from a join b using (run))
        select item_id, doc_id from c group by item_id, doc_id, n having 2 * count(*) >= n"""


SQL: dict[str, str] = {"p7_found": _leaks_sql()}
