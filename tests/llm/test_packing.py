"""Packing: nothing lost, nothing over capacity, nothing split without need, little unused space."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import packing
from lamella.tables import table


def checked(rows, counts, capacity):
    """Holds a packing of one target against its documents; gives the containers."""
    spans, held = defaultdict(list), defaultdict(int)
    for r in rows:
        spans[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
        if r["container_id"] is not None:
            held[r["container_id"]] += r["n_tokens"]
    for doc, n in counts.items():
        at = 0
        for start, size in sorted(spans[doc]):
            assert start == at
            at += size
        assert at == n
        if n <= capacity:
            assert len(spans[doc]) == 1
    assert set(spans) == set(counts) and all(0 < n <= capacity for n in held.values())
    return held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_assignment(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype="int64")
    at = packing.assign(sizes, 100)
    load = np.bincount(at, weights=sizes) if len(sizes) else np.zeros(0)
    assert (load <= 100).all()
    # two containers at most half full are never both open beyond the least number
    assert len(load) <= max(1, 2 * -(-int(sizes.sum()) // 100))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=150))
def test_no_more_sequences_than_best_fit(sizes):
    rooms = []
    for x in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(100 - x)
    at = packing.assign(np.array(sorted(sizes, reverse=True), dtype="int64"), 100)
    assert (max(at) + 1 if len(at) else 0) <= len(rooms) and set(at) == set(range(max(at) + 1 if len(at) else 0))


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    sizes = np.sort(np.minimum(rng.lognormal(5, 1, 3_000).astype("int64") + 1, 4_096))[::-1]
    price = sizes + sizes.astype(float) ** 2 * packing.QUADRATIC
    spread = lambda at: np.bincount(at, weights=price).std()
    assert spread(packing.assign(sizes, 4_096)) < 0.75 * spread(packing.tightest(sizes, 4_096))


def test_whole_documents(spark, data):
    docs, targets = table(spark, data, "documents"), table(spark, data, "pack_targets")
    counts = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert len(counts) == docs.count()
    packed = packing.packed_documents(docs, targets).collect()
    for target in targets.collect():
        held = checked([r for r in packed if r["target_id"] == target["target_id"]], counts, target["capacity_tokens"])
        assert sum(held.values()) == sum(counts.values())
    report = packing.fill_report(spark.createDataFrame(packed, packing.PACKED), targets).collect()
    assert all(r["unused"] < 0.2 for r in report if r["capacity_tokens"] <= 2048)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two three " * 400, "x"), (4, "a", "x"), (4, "a", "x")], "doc_id bigint, text string, n_tokens string")
    targets = spark.createDataFrame([(1, 50), (2, 0), (3, None)], "target_id bigint, capacity_tokens bigint")
    rows = packing.packed_documents(docs, targets).collect()
    assert {r["target_id"] for r in rows} == {1}
    empty = [r for r in rows if r["n_tokens"] == 0]
    assert sorted(r["doc_id"] for r in empty) == [1, 2] and all(r["container_id"] is None for r in empty)
    assert len([r for r in rows if r["doc_id"] == 4]) == 2
    assert len([r for r in rows if r["doc_id"] == 3]) == -(-sum(r["n_tokens"] for r in rows if r["doc_id"] == 3) // 50)
    assert packing.packed_documents(docs.limit(0), targets).count() == 0 and packing.packed_documents(docs, targets.limit(0)).count() == 0


def test_shards_lose_nothing(spark):
    counts = {i: (i * 37) % 90 + 1 for i in range(3_000)}
    df = spark.createDataFrame(list(counts.items()), "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([(7, 64)], "target_id bigint, capacity_tokens bigint")
    held = checked(packing.pack(df, targets, shard_items=500).collect(), counts, 64)
    assert sum(held.values()) / (64 * len(held)) > 0.8


@pytest.mark.parametrize("size", [1, 10, 50])
def test_pieces_count_as_the_whole(size):
    text = "Ein  kurzer Text, 12.5 mm²\n\n  mit Lücken\tund    Zeilen. " * 20 + "x" * 300
    encode = packing.encoder().encode_ordinary
    assert "".join(packing.chunks(text, size)) == text
    assert sum(len(encode(c)) for c in packing.chunks(text, size)) == len(encode(text))
