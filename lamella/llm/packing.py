"""Filling containers of fixed token capacity with texts.

Method. A sequence's cost is linear in its tokens plus quadratic in each document's (attention stays inside a document). Documents, longest first, go to
the sequence of lowest cost that still has room. Balanced sequences may end up with rooms too small for the last documents. Such a document takes the
place of a smaller one that fits elsewhere; and where balance alone would take more sequences than the tightest packing (best fit), a share of the longest
documents is placed tightly first, the smallest share of SHARES with which balance takes no more. A text longer than the capacity gives full containers
and one rest; no other text is split.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import spread, written

#: Where the public vocabulary files are, and the one used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: The public splitting pattern of byte-level BPE: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cost of a token, and of a pair of tokens within a document: of a model with hidden size 4096, where attention equals the rest near 12,288 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 12_288
#: Shares of the longest documents that may be placed by best fit before the others are placed by cost.
SHARES = (0.0, 0.5, 0.8, 0.95)
#: Items packed together in one task. The waste of a shard is less than one sequence beyond its own packing.
SHARD_ITEMS = 20_000
#: Texts are tokenised in pieces of about so many characters, cut where tokens cannot cross.
CHUNK = 200_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces, cut before a blank between two non-blanks, where the splitting pattern always begins a new part."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A byte-level BPE encoder from a public vocabulary file."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every document, over its whole text; null and empty texts have 0. Rows without doc_id are kept."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for part in parts:
            n = [sum(len(encode(c)) for c in chunks(t)) if t else 0 for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": np.array(n, dtype="int64")})

    return spread(documents.select("doc_id", "text"), "doc_id").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def tightest(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each item by best fit: sizes in descending order, none above the capacity."""
    rooms: list[tuple[int, int]] = []
    out = np.empty(len(sizes), dtype="int64")
    opened = 0
    for i, size in enumerate(sizes.tolist()):
        k = bisect.bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            room, at, opened = capacity, opened, opened + 1
        out[i] = at
        bisect.insort(rooms, (room - size, at))
    return out


def balanced(sizes: np.ndarray, capacity: int, price: np.ndarray, placed: np.ndarray, sequences: int) -> np.ndarray:
    """The sequence of each item, of which the first stand as `placed` says: the others go to the sequence of lowest cost with room, among at least so many."""
    n, m = len(sizes), len(placed)
    opened = max(sequences, int(placed.max()) + 1 if m else 0)
    room = np.concatenate([np.full(opened, capacity, dtype="int64"), np.zeros(n, dtype="int64")])
    cost = np.concatenate([np.zeros(opened), np.full(n, np.inf)])
    out = np.full(n, -1, dtype="int64")
    out[:m] = placed
    np.subtract.at(room, placed, sizes[:m])
    np.add.at(cost, placed, price[:m])

    def put(i: int, at: int) -> None:
        if out[i] >= 0:
            room[out[i]] += sizes[i]
            cost[out[i]] -= price[i]
        room[at] -= sizes[i]
        cost[at] += price[i]
        out[i] = at

    def cheapest(i: int) -> bool:
        fits = np.flatnonzero(room[:opened] >= sizes[i])
        if len(fits):
            put(i, fits[np.argmin(cost[fits])])
        return len(fits) > 0

    left = [i for i in range(m, n) if not cheapest(i)]
    for i in left:
        if cheapest(i):
            continue
        widest = int(np.argmax(room[:opened])) if opened else 0
        second = int(np.partition(room[:opened], -2)[-2]) if opened > 1 else 0
        gap = room[out] + sizes - sizes[i]  # what an exchange would leave of the room, for every item that stands somewhere
        able = (out >= 0) & (sizes < sizes[i]) & (gap >= 0) & (sizes <= np.where(out == widest, second, room[widest] if opened else 0))
        if able.any():
            j = int(np.flatnonzero(able)[np.argmin(gap[able])])
            at = int(out[j])
            others = np.flatnonzero((room[:opened] >= sizes[j]) & (np.arange(opened) != at))
            put(j, others[np.argmin(room[others])])
            put(i, at)
        else:
            room[opened], cost[opened] = capacity, 0.0
            put(i, opened)
            opened += 1
    return out


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each item: sizes in descending order, none above the capacity. Never more sequences than best fit takes."""
    sizes = np.asarray(sizes, dtype="int64")
    price = linear * sizes + quadratic * sizes.astype(float) ** 2
    tight = tightest(sizes, capacity)
    least = int(tight.max()) + 1 if len(sizes) else 0
    for share in SHARES:
        out = balanced(sizes, capacity, price, tight[: int(share * len(sizes))], least)
        if not len(out) or out.max() < least:
            return out
    return tight


PACKED = "target_id bigint, container_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


def pack(counts: DataFrame, targets: DataFrame, shard_items: int = SHARD_ITEMS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """counts(doc_id, n_tokens), targets(target_id, capacity_tokens) to target_id, container_id, doc_id, piece, start_token, n_tokens.

    Every token of every document is in exactly one row for each target. Documents without tokens stand in no container (container_id null). Targets
    without a positive capacity give no rows. Items are spread over shards by a hash of doc_id, so no task gets more than about `shard_items` of them.
    """
    spark = counts.sparkSession
    sized = targets.where("capacity_tokens > 0").select("target_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    n = counts.count()
    shards = max(1, -(-n // shard_items))
    wanted = sized.distinct().collect()  # a list of container sizes, never data
    if not wanted:
        return spark.createDataFrame([], PACKED)
    target = F.explode(F.array(*[F.struct(F.lit(r["target_id"]).cast("bigint").alias("target_id"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in wanted]))
    each = counts.select("doc_id", "n_tokens", target.alias("_t")).select("doc_id", "n_tokens", "_t.*").withColumn("whole", F.expr("case when n_tokens > capacity then n_tokens div capacity else 0 end"))
    full = each.where("whole > 0").select("target_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece"))
    full = full.select("target_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    rest = each.withColumn("size", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    none = rest.where("n_tokens = 0").select("target_id", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens")
    items = rest.where("size > 0").select("target_id", "capacity", "doc_id", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("capacity")).alias("start_token"), "size", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).alias("shard"))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = assign(part["size"].to_numpy(), int(part["capacity"].iloc[0]), linear, quadratic)
        names = [f"s{key[1]}-{x}" for x in at]
        return pd.DataFrame({"target_id": part["target_id"], "container_id": names, "doc_id": part["doc_id"], "piece": part["piece"], "start_token": part["start_token"], "n_tokens": part["size"]})

    return items.groupBy("target_id", "shard").applyInPandas(fill, PACKED).unionByName(full).unionByName(none)


def packed_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """All documents packed for every target. Token counts are written once to the shared folder, so no text is tokenised twice."""
    return pack(written(token_counts(documents, folder, vocabulary), "token-counts"), targets)


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: containers, tokens, unused share of the containers' space, and the share of documents that were split."""
    held = packed.where("container_id is not null").groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    held = held.groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    out = targets.join(held, "target_id", "left")
    return out.select("target_id", "capacity_tokens", F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "fullest", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))
