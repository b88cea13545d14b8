"""The byte layouts of encoded columns: runs, packed bits, base-128 numbers. Whole chunks at a time in numpy, a step in Python for each run; numbers beyond
62 bits take a plain way. Used through Arrow batches.

Spark's reader and writer do this for files; here it is open to inspection. Inputs that end early or hold surplus bytes raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamella.functions.bits import WIDTHS

#: Least and greatest length of a run, and greatest number of literals: fixed values of the format.
RUN_LEAST, RUN_MOST, LITERALS = 3, 130, 128


def zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def zag(n: int) -> int:
    return n >> 1 if not n & 1 else -(n >> 1) - 1


def put_varint(n: int, out: bytearray) -> None:
    """A number that isn't negative, seven bits to a byte, low bits first."""
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a number doesn't end")
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


#: Magnitude from which numbers are worked on one by one, as their differences or zigzag forms may leave 64 bits.
WIDE = 1 << 62


def narrow(values) -> np.ndarray | None:
    """The values as 64-bit numbers, or None where one is too wide."""
    try:
        v = np.asarray(values, dtype="int64")
    except OverflowError:
        return None
    return v if not len(v) or (v.max() < WIDE and v.min() > -WIDE) else None


def zigzagged(v: np.ndarray) -> np.ndarray:
    return (v << 1 ^ v >> 63).view("uint64")


def put_varints(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many each number takes) of numbers that aren't negative."""
    size = np.ones(len(u), dtype="int64")
    for k in range(1, 10):
        size += u >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(u) else 0, dtype="uint8")
    for k in range(int(size.max()) if len(u) else 0):
        own = np.flatnonzero(size > k)
        part = (u[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[own] - size[own] + k] = part.astype("uint8") | ((size[own] > k + 1) << 7).astype("uint8")
    return out, size


def encode_varints(values, signed: bool = True) -> bytes:
    v = narrow(values)
    if v is not None and (signed or not len(v) or v.min() >= 0):
        return put_varints(zigzagged(v) if signed else v.view("uint64"))[0].tobytes()
    out = bytearray()
    for x in values:
        put_varint(zig(int(x)) if signed else int(x), out)
    return bytes(out)


def get_varints(data: np.ndarray) -> np.ndarray | None:
    """The numbers in bytes that end with a number's end; None where one takes more than 62 bits."""
    ends = np.flatnonzero(data < 128)
    begins = np.r_[0, ends[:-1] + 1]
    size = ends - begins + 1
    if len(size) and size.max() > 8:
        return None
    out = np.zeros(len(ends), dtype="int64")
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        out[own] |= (data[begins[own] + k].astype("int64") & 127) << 7 * k
    return out


def decode_varints(data: bytes, signed: bool = True) -> list[int]:
    if data and data[-1] > 127:
        raise ValueError("a number doesn't end")
    u = get_varints(np.frombuffer(data, dtype="uint8"))
    if u is not None:
        return (u >> 1 ^ -(u & 1) if signed else u).tolist()
    out, at = [], 0
    while at < len(data):
        n, at = get_varint(data, at)
        out.append(zag(n) if signed else n)
    return out


def _segments(values, deltas: bool) -> Iterator[tuple[int, int, int | None]]:
    """(start, length, delta) of each run and (start, length, None) of each stretch of literals. Runs have one delta of -128..127, 0 where not `deltas`."""
    n = len(values)
    v = narrow(values)
    step = np.diff(v if v is not None else np.asarray(values, dtype=object))
    fits = (step >= -128) & (step <= 127) if deltas else step == 0
    # where the stretch of equal steps that holds each step ends
    last = np.flatnonzero(np.r_[step[1:] != step[:-1], True]) if n > 1 else np.zeros(0, dtype="int64")
    upto = last[np.searchsorted(last, np.arange(n - 1))] if n > 1 else last
    begins = np.flatnonzero(fits.astype(bool) & (upto - np.arange(max(0, n - 1)) + 2 >= RUN_LEAST)) if n > 1 else last
    literal = k = 0
    while True:
        k = int(np.searchsorted(begins, literal)) if k < len(begins) else k
        at = int(begins[k]) if k < len(begins) else n
        while literal < at:
            size = min(LITERALS, at - literal)
            yield literal, size, None
            literal += size
        if at == n:
            return
        size = min(RUN_MOST, int(upto[at]) - at + 2)
        yield at, size, int(step[at])
        literal = at + size


def encode_bytes(values: bytes) -> bytes:
    """Runs of equal bytes, and literals."""
    out = bytearray()
    for start, size, step in _segments(np.frombuffer(values, dtype="uint8").astype("int64"), False):
        if step is None:
            out.append(256 - size)
            out += values[start : start + size]
        else:
            out += bytes((size - RUN_LEAST, values[start]))
    return bytes(out)


def decode_bytes(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head, at = data[at], at + 1
        size = head + RUN_LEAST if head < 128 else 256 - head
        need = 1 if head < 128 else size
        if at + need > len(data):
            raise ValueError("a run doesn't end")
        out += data[at : at + 1] * size if head < 128 else data[at : at + size]
        at += need
    return bytes(out)


def encode_bits(values) -> bytes:
    """Booleans, the first in the highest bit, as runs of bytes."""
    return encode_bytes(np.packbits(np.asarray(values, dtype=bool)).tobytes())


def decode_bits(data: bytes, count: int) -> list[bool]:
    bits = np.unpackbits(np.frombuffer(decode_bytes(data), dtype=np.uint8))
    if len(bits) < count:
        raise ValueError("too few bits")
    return bits[:count].astype(bool).tolist()


def encode_runs(values, signed: bool = True) -> bytes:
    """Runs with a constant step, and literals (version 1). Whole values are compared, never their low byte alone."""
    v = narrow(values)
    if v is None or (not signed and len(v) and v.min() < 0):
        v = [int(x) for x in values]
        one = [encode_varints([x], signed) for x in v]
        body, ends = b"".join(one), np.cumsum([len(x) for x in one])
    else:
        data, size = put_varints(zigzagged(v) if signed else v.view("uint64"))
        body, ends = data.tobytes(), np.cumsum(size)
    begins = np.r_[0, ends]  # where each number's bytes stand, were it a literal
    out = bytearray()
    for start, size, step in _segments(v, True):
        out += bytes((256 - size,) if step is None else (size - RUN_LEAST, step & 255))
        out += body[begins[start] : begins[start + (size if step is None else 1)]]
    return bytes(out)


def decode_runs(data: bytes, signed: bool = True) -> list[int]:
    raw = np.frombuffer(data, dtype="uint8")
    ends = np.flatnonzero(raw < 128)
    out: list[int] = []
    at = 0
    while at < len(data):
        head = data[at]
        run = head < 128
        begin = at + (2 if run else 1)
        # the numbers end at bytes below 128
        k = int(np.searchsorted(ends, begin)) + (0 if run else 255 - head)
        if begin > len(data) or k >= len(ends):
            raise ValueError("a run doesn't end")
        at = int(ends[k]) + 1
        own = decode_varints(data[begin:at], signed)
        if run:
            step = data[begin - 1] - 256 if data[begin - 1] > 127 else data[begin - 1]
            out += range(own[0], own[0] + step * (head + RUN_LEAST), step) if step else own * (head + RUN_LEAST)
        else:
            out += own
    return out


def unpack(data: bytes, width: int, count: int) -> list[int]:
    """`count` numbers of `width` bits each, at most 64, high bits first."""
    if width * count > 8 * len(data):
        raise ValueError("too few bits")
    bits = np.unpackbits(np.frombuffer(data, dtype="uint8"), count=width * count).reshape(count, width)
    out = np.zeros(count, dtype="uint64")
    for k in range(width):
        out = out << np.uint64(1) | bits[:, k]
    return out.tolist()


def pack(values, width: int) -> bytes:
    whole, n = 0, 0
    for v in values:
        whole, n = whole << width | int(v), n + width
    pad = -n % 8
    return (whole << pad).to_bytes((n + pad) // 8, "big")


def closest_width(bits: int) -> int:
    """The narrowest supported width of at least so many bits."""
    return next(w for w in WIDTHS if w >= bits)


def decode_runs_2(data: bytes, signed: bool = True) -> list[int]:
    """Version 2: short repeats, packed numbers, packed numbers with patches, and deltas."""
    out: list[int] = []
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("a run doesn't end")
        at += n
        return data[at - n : at]

    fix = zag if signed else (lambda n: n)
    while at < len(data):
        head = take(1)[0]
        form, code = head >> 6, head >> 1 & 31
        if form == 0:
            out += [fix(int.from_bytes(take((head >> 3 & 7) + 1), "big"))] * ((head & 7) + 3)
            continue
        count = ((head & 1) << 8 | take(1)[0]) + 1
        if form == 1:
            width = WIDTHS[code]
            out += map(fix, unpack(take(-(-width * count // 8)), width, count))
        elif form == 2:
            width, third, fourth = WIDTHS[code], *take(2)
            size, patch_width = (third >> 5) + 1, WIDTHS[third & 31]
            gap_width, patches = (fourth >> 5) + 1, fourth & 31
            base = int.from_bytes(take(size), "big")
            sign = 1 << (8 * size - 1)
            base = -(base - sign) if base & sign else base
            values = unpack(take(-(-width * count // 8)), width, count)
            entry = closest_width(patch_width + gap_width)
            place = 0
            for p in unpack(take(-(-entry * patches // 8)), entry, patches):
                place += p >> patch_width
                values[place] |= (p & (1 << patch_width) - 1) << width
            out += [base + v for v in values]
        else:
            width = WIDTHS[code] if code else 0
            n, at = get_varint(data, at)
            first = fix(n)
            n, at = get_varint(data, at)
            step = zag(n)
            out.append(first)
            if count > 1:
                out.append(first + step)
            rest = unpack(take(-(-width * (count - 2) // 8)), width, count - 2) if width and count > 2 else [abs(step)] * max(0, count - 2)
            for d in rest:
                out.append(out[-1] + (d if step >= 0 else -d))
    return out


def encode_floats(values, size: int = 8) -> bytes:
    return np.asarray(values, dtype=f"<f{size}").tobytes()


def decode_floats(data: bytes, size: int = 8) -> list[float]:
    if len(data) % size:
        raise ValueError("not a whole number of values")
    return np.frombuffer(data, dtype=f"<f{size}").tolist()


#: Codecs by name: how to encode and decode a chunk of values.
CODECS: dict[str, tuple[Callable, Callable]] = {
    "varint": (encode_varints, decode_varints),
    "runs": (encode_runs, decode_runs),
    "bytes": (lambda v: encode_bytes(bytes(int(x) & 255 for x in v)), lambda d: list(decode_bytes(d))),
    "double": (encode_floats, decode_floats),
    "float": (lambda v: encode_floats(v, 4), lambda d: decode_floats(d, 4)),
    "runs2": (None, decode_runs_2),
}


def encode_chunks(chunks: DataFrame, codec: str) -> DataFrame:
    """chunks(chunk, items array) to (chunk, n, body binary). Null arrays give null bodies. A chunk is a stripe's worth of values, in order."""
    encode = CODECS[codec][0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"chunk": part["chunk"], "n": [0 if v is None else len(v) for v in part["items"]], "body": [None if v is None else encode(v) for v in part["items"]]})

    return chunks.select("chunk", "items").mapInPandas(run, "chunk bigint, n bigint, body binary")


def decode_chunks(bodies: DataFrame, codec: str, item: str = "bigint") -> DataFrame:
    """The inverse of encode_chunks: (chunk, items)."""
    decode = CODECS[codec][1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"chunk": part["chunk"], "items": [None if b is None else decode(bytes(b)) for b in part["body"]]})

    return bodies.select("chunk", "body").mapInPandas(run, f"chunk bigint, items array<{item}>")
