"""Far too many small files: which to join, into which containers, and the joining itself, byte for byte.

Newline-delimited files and complete zstandard frames are concatenated without parsing them: a missing last newline is supplied, a repeated header line is
dropped, frames are copied as they are. Every source is held against the length and checksum stated for it when it was written, and a joined file, read
back, against the bytes that went into it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.ordered import split_sum
from lamella.operators.registry import registered_files, stripe_lengths
from lamella.session import fresh_path, removed, written
from lamella.sources.files import opened, put

#: Files below this many bytes of data are small.
SMALL = 65_536
#: Bytes that a joined file should have: at least one block of a distributed file system.
TARGET = 134_217_728
#: Files that a joined file may be made of; a task lists them.
MOST_FILES = 50_000


def small_files(orc_files: DataFrame, stripes: DataFrame, small: int = SMALL) -> DataFrame:
    """Files whose stripes hold a row and whose data is known to be shorter than `small`, but no retried uploads.

    A retried upload has the body_digest of an earlier written file of its feed (at equal times the lower file_id is the earlier); a null digest is never one.
    A file of which a stripe's length stays unknown is not taken for small. Rows: file_id, feed_id, day, written_at, data_bytes, rows.
    """
    files = registered_files(orc_files)
    sizes = stripe_lengths(stripes, files).groupBy("file_id").agg(
        F.sum("data_length").alias("data_bytes"), F.count_if(F.col("data_length").isNull()).alias("unknown"), F.sum(F.coalesce("si_number_of_rows", F.lit(0))).alias("rows")
    )
    # the first upload of each body: one aggregate, so that a body with a third of all uploads is no single group
    bodies = files.where("body_digest is not null").groupBy("feed_id", "body_digest").agg(F.min(F.struct("written_at", "file_id")).alias("first"))
    firsts = bodies.select(F.col("first.file_id").alias("file_id")).unionByName(files.where("body_digest is null").select("file_id"))
    kept = files.join(firsts, "file_id", "left_semi").join(sizes.where(f"unknown = 0 and rows >= 1 and data_bytes < {small}"), "file_id")
    return kept.select("file_id", "feed_id", F.to_date("written_at").alias("day"), "written_at", "data_bytes", "rows")


def compaction_plan(orc_files: DataFrame, stripes: DataFrame, small: int = SMALL, target: int = TARGET) -> DataFrame:
    """Containers for the small files: file_id, feed_id, day, container (from 0 within feed and day), offset (bytes before it there), data_bytes, rows.

    Files of one feed and day are laid end to end by written_at and cut every `target` bytes, so a container exceeds the target by less than one small file.
    A file counts as target / MOST_FILES bytes at least, so that tiny ones don't gather without bound.
    A file alone in its feed and day has nothing to be joined with and is left out. Null feeds form one feed; files without a day are left out.
    """
    it = small_files(orc_files, stripes, small).where("day is not null")
    it = it.withColumn("weight", F.greatest("data_bytes", F.lit(target // MOST_FILES)))
    laid = split_sum(it, ["feed_id", "day"], ["written_at", "file_id"], F.hour("written_at"), "weight", "before")
    whole = it.groupBy(F.col("feed_id").alias("_feed"), F.col("day").alias("_day")).agg(F.count("*").alias("files"))
    joined = laid.join(whole.where("files >= 2"), laid["feed_id"].eqNullSafe(whole["_feed"]) & (laid["day"] == whole["_day"]))
    inside = Window.partitionBy("feed_id", "day", "container").orderBy("written_at", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.withColumn("container", F.floor(F.col("before") / target))
    return cut.select("file_id", "feed_id", "day", "container", F.coalesce(F.sum("data_bytes").over(inside), F.lit(0)).alias("offset"), "written_at", "data_bytes", "rows")


#: The first bytes of a zstandard frame and of a skippable one, little endian: fixed values.
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50


def frame_lengths(data: bytes) -> list[int]:
    """The lengths of the zstandard frames that make up `data`, from their headers and block headers alone. Raises ValueError where they are not complete."""
    out, at = [], 0
    while at < len(data):
        begin = at
        if len(data) < at + 8:
            raise ValueError("incomplete frame")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            bits = data[at + 4]
            single, sized = bits >> 5 & 1, bits >> 6
            at += 5 + (1 - single) + (0, 1, 2, 4)[bits & 3] + ((1 if single else 0), 2, 4, 8)[sized]
            while True:
                if len(data) < at + 3:
                    raise ValueError("incomplete frame")
                head = int.from_bytes(data[at : at + 3], "little")
                kind, size = head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError("reserved block type")
                at += 3 + (1 if kind == 1 else size)
                if head & 1:
                    break
            at += 4 * (bits >> 2 & 1)
        else:
            raise ValueError("not a zstandard frame")
        if at > len(data):
            raise ValueError("incomplete frame")
        out.append(at - begin)
    return out


class Damaged(ValueError):
    """A file that isn't what it is stated to be."""


def compact_paths(plan: DataFrame, form: str = "lines", header: bytes | None = None, chunk: int = 8 << 20) -> DataFrame:
    """Joins files: plan(target_path, ordinal, source_path, length, crc) to (target_path, files, bytes, crc, intact, fault).

    length and crc (CRC-32), where not null, are those of the source as it was written. Each target is written by one task under a temporary name, read
    back, and renamed only if every source and the whole have the right length and CRC-32; otherwise it is removed, and `fault` says why. So a lost
    executor leaves no half file; sources are never touched. Bytes stream through in chunks; only with form `zstd` a source is read as a whole, to check
    that it consists of whole frames. A target is bounded by the plan, its sources are listed in one row.
    """
    if form not in ("lines", "zstd"):
        raise ValueError(f"unknown form {form!r}")

    def pieces(it):
        """The bytes of a source, checked when the last one has gone through."""
        system, path = opened(it["source_path"])
        crc, length = 0, 0
        with system.open_input_stream(path, compression=None) as f:
            if form == "zstd":
                data = f.read()
                frame_lengths(data)
                crc, length = zlib.crc32(data), len(data)
                yield data
            else:
                first = True
                while data := f.read(chunk):
                    crc, length = zlib.crc32(data, crc), length + len(data)
                    if first and header is not None and data.startswith(header):
                        data = data[len(header) :]
                    first = False
                    yield data
        if it["length"] is not None and it["length"] != length or it["crc"] is not None and it["crc"] != crc:
            raise Damaged(f"{it['source_path']} has {length} bytes with checksum {crc}, not {it['length']} with {it['crc']}")

    def joined(target: str, items) -> tuple[int, int]:
        import uuid

        system, path = opened(target)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.part"
        crc, length = 0, 0
        try:
            with system.open_output_stream(temporary, compression=None) as out:

                def add(data: bytes) -> None:
                    nonlocal crc, length
                    out.write(data)
                    crc, length = zlib.crc32(data, crc), length + len(data)

                if header is not None and form == "lines":
                    add(header)
                for it in items:
                    last = b""
                    for data in pieces(it):
                        add(data)
                        last = data[-1:] or last
                    if form == "lines" and last and last != b"\n":
                        add(b"\n")
            back, size = 0, 0
            with system.open_input_stream(temporary, compression=None) as f:
                while data := f.read(chunk):
                    back, size = zlib.crc32(data, back), size + len(data)
            if (back, size) != (crc, length):
                raise Damaged(f"{target} came back with {size} bytes, not {length}")
            system.move(temporary, path)
        except ValueError:
            system.delete_file(temporary)
            raise
        return length, crc

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for target, items in zip(part["target_path"], part["items"]):
                try:
                    rows.append((target, len(items), *joined(target, items), True, None))
                except ValueError as e:
                    rows.append((target, len(items), 0, 0, False, str(e)))
            yield pd.DataFrame(rows, columns=["target_path", "files", "bytes", "crc", "intact", "fault"])

    grouped = plan.groupBy("target_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_path", "length", "crc"))).alias("items"))
    # a row may stand for 128 MB of work, so few of them go to a task at once
    return grouped.mapInPandas(run, "target_path string, files bigint, bytes bigint, crc bigint, intact boolean, fault string")


def file_lines(plan: DataFrame, row_records: DataFrame, nested_rows: DataFrame) -> DataFrame:
    """file_id, id, line: the rows of the plan's files as JSON, file by file and in row order, deliveries of one record one after another, the earliest
    first. Each file begins with a row without a line. The plan is joined before anything is shuffled by file, and rendered after.
    """
    late = F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("late")
    small = plan.select("file_id")
    columns = [c for c in row_records.columns if c != "ingested_at"]
    flat = row_records.join(small, "file_id", "left_semi").select("file_id", F.col("record_id").alias("id"), "stripe_no", "row_no", late, F.struct(*columns).alias("flat"))
    nested = nested_rows.join(small, "file_id", "left_semi").select("file_id", F.col("row_id").alias("id"), F.lit(0).alias("stripe_no"), "row_no", late, F.struct("row_id", "row_no", "payload").alias("nested"))
    begin = small.select("file_id", F.lit(True).alias("begin"))
    rows = flat.unionByName(nested, allowMissingColumns=True).unionByName(begin, allowMissingColumns=True)
    rows = rows.repartition("file_id").sortWithinPartitions("file_id", F.col("begin").asc_nulls_last(), "stripe_no", "row_no", F.col("id").asc_nulls_last(), "late")
    return rows.select("file_id", F.col("id").cast("string").alias("id"), F.when(F.col("begin").isNull(), F.coalesce(F.to_json("flat"), F.to_json("nested"))).alias("line"))


def written_files(plan: DataFrame, row_records: DataFrame, nested_rows: DataFrame, folder: str, form: str) -> DataFrame:
    """Writes each file of the plan as a file of its own: file_id, source_path, length, crc, records.

    The tables hold what the feeds' files contain, not the files; these stand for them, newline-delimited without a last newline, with form `zstd` as one
    frame. Each record stands in its file once; one without an id at each delivery; a file without rows is an empty file.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        packer = zstandard.ZstdCompressor(write_checksum=True)
        now, before, lines = None, None, []

        def closed() -> tuple:
            data = "\n".join(lines).encode()
            if form == "zstd" and lines:
                data = packer.compress(data + b"\n")
            path = f"{folder}/{now % 997}/{now}"
            put(path, data)
            return now, path, len(data), zlib.crc32(data), len(lines)

        columns = ["file_id", "source_path", "length", "crc", "records"]
        for part in parts:
            rows = []
            for file_id, id_, line in zip(part["file_id"].to_numpy(), part["id"], part["line"]):
                if file_id != now:
                    if now is not None:
                        rows.append(closed())
                    now, before, lines = int(file_id), None, []
                if line is not None and (id_ is None or id_ != before):
                    lines.append(line)
                    before = id_
            yield pd.DataFrame(rows, columns=columns)
        if now is not None:
            yield pd.DataFrame([closed()], columns=columns)

    lines = file_lines(plan, row_records, nested_rows)
    return lines.mapInPandas(write, "file_id bigint, source_path string, length bigint, crc bigint, records bigint")


def joined_files(plan: DataFrame, row_records: DataFrame, nested_rows: DataFrame, form: str = "zstd", keep: bool = False) -> DataFrame:
    """The plan carried out: file_id, container_id, records, bytes, container_bytes, container_crc, intact, fault, container_path, one row per small file.

    The small files are written out one by one (see written_files), each with its length and checksum, and then joined byte by byte by compact_paths.
    The small files are removed, and with keep=False the containers too, once the result is written.
    """
    spark = plan.sparkSession
    folder = fresh_path(spark, "compacted")
    plan = written(plan, "compaction-plan")  # its size is known to the joins
    sources = written(written_files(plan, row_records, nested_rows, f"{folder}/small", form), "small-files")
    name = F.concat_ws("/", F.coalesce(F.col("feed_id").cast("string"), F.lit("none")), F.col("day").cast("string"), F.col("container").cast("string"))
    laid = plan.join(sources, "file_id").withColumn("container_id", name)
    laid = laid.withColumn("target_path", F.concat(F.lit(f"{folder}/joined/"), "container_id"))
    done = written(compact_paths(laid.select("target_path", F.struct("written_at", "file_id").alias("ordinal"), "source_path", "length", "crc"), form), "joined-files")
    removed(spark, f"{folder}/small")
    if not keep:
        removed(spark, f"{folder}/joined")
    done = done.select("target_path", F.col("bytes").alias("container_bytes"), F.col("crc").alias("container_crc"), "intact", "fault")
    return laid.join(done, "target_path").select("file_id", "container_id", "records", F.col("length").alias("bytes"), "container_bytes", "container_crc", "intact", "fault", F.col("target_path").alias("container_path"))
