"""The table of file footers, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that later operators use; others, whatever their names, are dropped.
KEPT = ["feed_id", "dataset", "file_path", "file_layout", "written_at", "body_digest", "content_length", "number_of_rows"]


def registered_files(orc_files: DataFrame) -> DataFrame:
    """One row per file_id: the first registration (a null registered_at counts as the first). Rows without a file_id are dropped.

    `date_order` is the value of the user metadata item date.order in lower case, null where the footer has none.
    """
    items = F.filter("user_metadata", lambda x: x["item_name"] == "date.order")
    order = F.lower(F.trim(F.try_element_at(items, F.lit(1))["item_value"]))
    rows = orc_files.where("file_id is not null").select("file_id", F.struct("registered_at", *KEPT, order.alias("date_order")).alias("_it"))
    return rows.groupBy("file_id").agg(F.min("_it").alias("_it")).select("file_id", *[F.col("_it")[c].alias(c) for c in [*KEPT, "date_order"]])


def stripe_lengths(stripes: DataFrame, files: DataFrame) -> DataFrame:
    """Each stripe once, with a missing data_length worked out from its neighbours.

    A stripe is index, data and footer back to back, so data ends where the footer begins: before the next stripe's offset or, for the last one,
    before content_length. Where that is unknown too, data_length stays null. Repeated rows collapse; of rows that differ the largest values count.
    """
    from pyspark.sql import Window

    wide = ["stripe_offset", "index_length", "data_length", "footer_length", "si_number_of_rows", "writer_timezone"]
    once = stripes.where("file_id is not null").groupBy("file_id", "stripe_no").agg(*[F.max(c).alias(c) for c in wide])
    # the stripes of one file are bounded by its footer, so this window never holds more than one footer
    ahead = F.lead("stripe_offset").over(Window.partitionBy("file_id").orderBy("stripe_no"))
    ends = once.withColumn("_next", ahead).join(files.select("file_id", "content_length"), "file_id", "left")
    derived = F.coalesce("_next", "content_length") - F.col("stripe_offset") - F.coalesce("index_length", F.lit(0)) - F.coalesce("footer_length", F.lit(0))
    return ends.select("file_id", "stripe_no", "stripe_offset", F.coalesce("data_length", derived).alias("data_length"), "si_number_of_rows", "writer_timezone")
