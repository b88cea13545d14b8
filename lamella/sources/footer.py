"""The metadata of ORC files: postscript, footer, stripes, types, statistics and user items, as tables.

Only the tail of a file is read. The tail is protobuf; a reader of its wire format is a few lines, and the numbers of the fields are in the public
specification of the format.
"""

from __future__ import annotations

import datetime
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lamella.sources.files import opened

#: Names by number: fixed values of the format.
COMPRESSIONS = ("none", "zlib", "snappy", "lzo", "lz4", "zstd")
STREAMS = ("PRESENT", "DATA", "LENGTH", "DICTIONARY_DATA", "DICTIONARY_COUNT", "SECONDARY", "ROW_INDEX", "BLOOM_FILTER", "BLOOM_FILTER_UTF8")
ENCODINGS = ("DIRECT", "DICTIONARY", "DIRECT_V2", "DICTIONARY_V2")
KINDS = ("BOOLEAN", "BYTE", "SHORT", "INT", "LONG", "FLOAT", "DOUBLE", "STRING", "BINARY", "TIMESTAMP", "LIST", "MAP", "STRUCT", "UNION", "DECIMAL", "DATE", "VARCHAR", "CHAR", "TIMESTAMP_INSTANT")


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position) of a base-128 number; an unended one raises ValueError."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a number doesn't end")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def message(data: bytes) -> dict[int, list]:
    """The fields of a protobuf message by number; nested messages stay bytes."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("a field doesn't end")
        out.setdefault(number, []).append(value)
    return out


def numbers(values: list) -> list[int]:
    """A repeated number, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            at = 0
            while at < len(v):
                x, at = varint(v, at)
                out.append(x)
    return out


def inflate(data: bytes, compression: str) -> bytes:
    """The blocks of a compressed section: a three-byte header gives the length and whether the block is kept as it was."""
    if compression == "none":
        return data
    out, at = [], 0
    while at < len(data):
        head = int.from_bytes(data[at : at + 3], "little")
        body = data[at + 3 : at + 3 + (head >> 1)]
        at += 3 + (head >> 1)
        if head & 1:
            out.append(body)
        elif compression == "zlib":
            out.append(zlib.decompress(body, wbits=-15))
        elif compression == "zstd":
            import zstandard

            out.append(zstandard.ZstdDecompressor().decompressobj().decompress(body))
        elif compression == "snappy":
            import pyarrow

            size, _ = varint(body, 0)
            out.append(pyarrow.Codec("snappy").decompress(body, decompressed_size=size, asbytes=True))
        else:
            raise ValueError(f"{compression} is not read")
    return b"".join(out)


def zagged(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def typed_statistics(column: dict[int, list]) -> dict:
    """minimum, maximum, total of a column as text, whichever kind it states; null where it states none. Dates as days become dates, moments milliseconds."""
    show = {"sint": lambda v: str(zagged(v)), "double": lambda v: repr(struct.unpack("<d", v)[0]), "text": lambda v: v.decode("utf-8", "replace"), "date": lambda v: str(datetime.date(1970, 1, 1) + datetime.timedelta(zagged(v)))}
    #: By field of the column's record: how its minimum, maximum and total are kept; fixed values of the format.
    forms = {2: ("sint", "sint", "sint"), 3: ("double", "double", "double"), 4: ("text", "text", "sint"), 6: ("text", "text", "text"), 7: ("date", "date", None), 8: (None, None, None), 9: ("sint", "sint", None)}
    out = dict.fromkeys(("minimum", "maximum", "total"))
    for number, kinds in forms.items():
        if number in column:
            own = message(column[number][0])
            for i, (name, kind) in enumerate(zip(out, kinds), 1):
                if kind and i in own:
                    out[name] = show[kind](own[i][0])
            if number == 8 and 1 in own:
                out["total"] = show["sint"](own[1][0])
    if 5 in column:  # of booleans: how many are true
        own = message(column[5][0])
        out["total"] = str(numbers(own.get(1, [0]))[0])
    return out


def parse_stripe(data: bytes, compression: str) -> dict:
    """The footer of a stripe: its streams, each column's encoding, and the writer's time zone."""
    m = message(inflate(data, compression))
    one = lambda x, k, d=0: x.get(k, [d])[0]
    streams, encodings = [message(x) for x in m.get(1, [])], [message(x) for x in m.get(2, [])]
    return {
        "streams": [{"column_id": one(x, 2), "stream": STREAMS[one(x, 1)] if one(x, 1) < len(STREAMS) else str(one(x, 1)), "length": one(x, 3)} for x in streams],
        "encodings": [{"column_id": i, "encoding": ENCODINGS[one(x, 1)], "dictionary_size": one(x, 2, None)} for i, x in enumerate(encodings)],
        "writer_timezone": one(m, 3, b"").decode() or None,
    }


def parse_tail(path: str, size: int, tail: bytes) -> dict:
    """Postscript and footer from the last bytes of a file. Raises ValueError if they are not those of an ORC file or don't reach far enough back."""
    one = lambda m, k, d=0: m.get(k, [d])[0]
    if not tail:
        raise ValueError("an empty file")
    length = tail[-1]
    post = message(tail[-1 - length : -1])
    if one(post, 8000, b"") != b"ORC":
        raise ValueError("no magic in the postscript")
    compression = COMPRESSIONS[one(post, 2)]
    footer_length = one(post, 1)
    if footer_length + length + 1 > len(tail):
        raise ValueError("the tail is too short")
    foot = message(inflate(tail[-1 - length - footer_length : -1 - length], compression))
    stripes = [message(x) for x in foot.get(3, [])]
    types = [message(x) for x in foot.get(4, [])]
    items = [message(x) for x in foot.get(5, [])]
    stats = [message(x) for x in foot.get(7, [])]
    return {
        "file_path": path,
        "file_bytes": size,
        "compression": compression,
        "block_size": one(post, 3) if 3 in post else None,
        "writer_version": numbers(post.get(4, [])),
        "metadata_length": one(post, 5),
        "header_length": one(foot, 1),
        "content_length": one(foot, 2),
        "number_of_rows": one(foot, 6),
        "row_index_stride": one(foot, 8),
        "stripes": [{"stripe_no": i, "stripe_offset": one(s, 1), "index_length": one(s, 2), "data_length": one(s, 3), "footer_length": one(s, 4), "rows": one(s, 5)} for i, s in enumerate(stripes)],
        "types": [{"type_id": i, "kind": KINDS[one(t, 1)], "subtypes": numbers(t.get(2, [])), "field_names": [x.decode() for x in t.get(3, [])], "maximum_length": one(t, 4, None), "precision": one(t, 5, None), "scale": one(t, 6, None)} for i, t in enumerate(types)],
        "user_metadata": [{"item_name": one(x, 1, b"").decode(), "item_value": one(x, 2, b"").decode("utf-8", "replace")} for x in items],
        "statistics": [{"column_id": i, "number_of_values": one(s, 1, None), "has_null": bool(one(s, 10)) if 10 in s else None, **typed_statistics(s)} for i, s in enumerate(stats)],
    }


FOOTER = (
    "file_path string, file_bytes bigint, compression string, block_size bigint, writer_version array<int>, metadata_length bigint, header_length bigint, content_length bigint, "
    "number_of_rows bigint, row_index_stride bigint, "
    "stripes array<struct<stripe_no:int,stripe_offset:bigint,index_length:bigint,data_length:bigint,footer_length:bigint,rows:bigint>>, "
    "types array<struct<type_id:int,kind:string,subtypes:array<int>,field_names:array<string>,maximum_length:int,precision:int,scale:int>>, "
    "user_metadata array<struct<item_name:string,item_value:string>>, statistics array<struct<column_id:int,number_of_values:bigint,has_null:boolean,minimum:string,maximum:string,total:string>>, error string"
)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files below a path, without reading them; Spark passes over files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.orc").load(path).select("path", "length")


def footers(spark: SparkSession, path: str, guess: int = 16_384) -> DataFrame:
    """One row per ORC file below a path, with its whole footer; a file that is none has only its path and `error`.

    Files are listed once, and their heads and tails are read by the executors: the last `guess` bytes, and more where the footer is longer.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            names = [x.split()[0] for x in re.sub(r"<.*?>+(?=, |$)", "", FOOTER).split(", ")]
            for name, size in zip(part["path"], part["length"]):
                try:
                    system, local = opened(name)
                    want = guess
                    while True:
                        with system.open_input_file(local) as f:
                            if f.read(3) != b"ORC":
                                raise ValueError("no magic in the header")
                            f.seek(max(0, size - want))
                            tail = f.read()
                        try:
                            rows.append(parse_tail(name, int(size), tail) | {"error": None})
                            break
                        except ValueError as e:
                            if "too short" not in str(e) or want >= size:
                                raise
                            want *= 16
                except Exception as e:
                    rows.append(dict.fromkeys(names) | {"file_path": name, "file_bytes": int(size), "error": str(e)})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return list_files(spark, path).mapInPandas(read, FOOTER)


STRIPES = (
    "file_path string, stripe_no int, rows bigint, streams array<struct<column_id:int,stream:string,length:bigint>>, "
    "encodings array<struct<column_id:int,encoding:string,dictionary_size:int>>, writer_timezone string"
)


def stripe_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per stripe of the files below a path: its streams, the encoding of each column, and the time zone of its writer. No data is read.

    A stripe whose footer can't be read raises an error; files that are none have no rows.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, compression, stripes in zip(part["file_path"], part["compression"], part["stripes"]):
                system, local = opened(name)
                with system.open_input_file(local) as f:
                    for s in stripes:
                        f.seek(s["stripe_offset"] + s["index_length"] + s["data_length"])
                        rows.append({"file_path": name, "stripe_no": s["stripe_no"], "rows": s["rows"], **parse_stripe(f.read(s["footer_length"]), compression)})
            yield pd.DataFrame(rows, columns=["file_path", "stripe_no", "rows", "streams", "encodings", "writer_timezone"], dtype=object)

    return footers(spark, path).where("error is null").select("file_path", "compression", "stripes").mapInPandas(read, STRIPES)


INDEXES = ("ROW_INDEX", "BLOOM_FILTER", "BLOOM_FILTER_UTF8")


def stream(f, stripe: dict, footer: dict, compression: str, column_id: int, kind: str) -> bytes:
    """The bytes of one stream of a stripe, decompressed; none where the stripe has no such stream. Streams stand back to back, those of indexes first."""
    at = stripe["stripe_offset"]
    for s in sorted(footer["streams"], key=lambda x: x["stream"] not in INDEXES):
        if (s["column_id"], s["stream"]) == (column_id, kind):
            f.seek(at)
            return inflate(f.read(s["length"]), compression)
        at += s["length"]
    return b""


def whole_numbers(spark: SparkSession, path: str, column_ids: list[int]) -> DataFrame:
    """file_path, stripe_no, column_id, present, value: whole-number columns decoded straight from their streams, without the reader of files.

    The present values of a stripe come in order, `present` counts them. Both versions of runs are read, as the column's encoding says.
    """
    from lamella.functions import codecs

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, compression, stripes in zip(part["file_path"], part["compression"], part["stripes"]):
                system, local = opened(name)
                with system.open_input_file(local) as f:
                    for s in stripes:
                        f.seek(s["stripe_offset"] + s["index_length"] + s["data_length"])
                        foot = parse_stripe(f.read(s["footer_length"]), compression)
                        for c in column_ids:
                            decode = codecs.decode_runs_2 if foot["encodings"][c]["encoding"].endswith("V2") else codecs.decode_runs
                            values = decode(stream(f, s, foot, compression, c, "DATA"))
                            yield pd.DataFrame({"file_path": name, "stripe_no": s["stripe_no"], "column_id": c, "present": range(len(values)), "value": values})

    schema = "file_path string, stripe_no int, column_id int, present bigint, value bigint"
    return footers(spark, path).where("error is null").select("file_path", "compression", "stripes").mapInPandas(read, schema)


def check_file(spark: SparkSession, path: str) -> tuple[list[dict], str, str]:
    """(stripes, schema, codec) of one file, without reading its data; raises ValueError on a file that is none."""
    row = footers(spark, path).first()
    if row is None or row["error"]:
        raise ValueError(f"{path}: {row['error'] if row else 'no file'}")
    return [s.asDict() for s in row["stripes"]], spark.read.orc(path).schema.simpleString(), row["compression"]
