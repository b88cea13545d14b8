"""The general problems against brute force on whole small tables, and their edge cases."""

import datetime as dt
import json

import brute
import pytest
from pyspark.sql import functions as F

from lamella.operators import compaction, drift, instants, profile, shredding
from lamella.sources import files
from lamella.tables import table

TABLES = ("orc_files", "file_types", "stripes", "column_stats", "row_records", "nested_rows")


@pytest.fixture(scope="module")
def t(spark, data):
    return {n: table(spark, data, n).cache() for n in TABLES}


def run(t):
    """Every operator's result, as sets and lists of tuples."""
    return {
        "p1": [tuple(r) for r in drift.schema_changes(t["orc_files"], t["file_types"]).select("file_id", "change_kind", "field_path").collect()],
        "p2": [tuple(r) for r in shredding.children(t["nested_rows"], t["file_types"]).collect()],
        "p3": [tuple(r) for r in profile.issues(t["row_records"], t["orc_files"], t["column_stats"]).collect()],
        "p4": [r[0] for r in compaction.joined_files(compaction.compaction_plan(t["orc_files"], t["stripes"]), t["row_records"], t["nested_rows"]).where("intact").select("file_id").collect()],
        "p5": [tuple(r) for r in instants.instants(t["row_records"], t["stripes"], t["orc_files"]).collect()],
    }


@pytest.fixture(scope="module")
def result(t):
    return run(t)


def test_against_brute_force(spark, t, result):
    plain = {n: brute.rows(df) for n, df in t.items()}
    assert set(result["p1"]) == brute.schema_changes(plain["orc_files"], plain["file_types"])
    assert sorted(result["p2"]) == sorted(brute.children(plain["file_types"], plain["nested_rows"]))
    assert set(result["p3"]) == brute.issues(plain["row_records"], plain["orc_files"], plain["column_stats"])
    assert set(result["p4"]) == brute.joined_files(plain["orc_files"], plain["stripes"])
    assert dict(result["p5"]) == brute.instants(plain["row_records"], plain["stripes"], plain["orc_files"])
    for name, rows in result.items():
        assert rows and len(rows) == len(set(rows)), name


def test_empty_tables(spark, t):
    assert run({n: df.limit(0) for n, df in t.items()}) == {"p1": [], "p2": [], "p3": [], "p4": [], "p5": []}


def test_null_rows_extra_columns_and_repeats_change_nothing(spark, t, result):
    def worse(df):
        empty = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        more = df.unionByName(df).unionByName(empty)
        return more.withColumns({c: F.lit("x") for c in ("_bucket", "version", "tree", "_t", "utc_us", "c", "l", "count", "rows", "issue", "path", "day", "before", "_z", "zone_id")})

    again = run({n: worse(df) for n, df in t.items()})
    for name, rows in result.items():
        assert sorted(again[name]) == sorted(rows), name


def tree_table(spark, files):
    """files: {file_id: {type_id: (kind, subtypes, names)}}, all of feed 1, written in order of file_id."""
    types = [(f, i, k, s, n, None, None, None) for f, x in files.items() for i, (k, s, n) in x.items()]
    orc = [(f, 1, "d", f"/{f}", "nested", dt.datetime(2024, 1, 1, 0, f % 60, 0), dt.datetime(2024, 1, 2), f"b{f}") for f in files]
    names = "file_id bigint, feed_id bigint, dataset string, file_path string, file_layout string, written_at timestamp_ntz, registered_at timestamp_ntz, body_digest string"
    df = spark.createDataFrame(orc, names).withColumns({"content_length": F.lit(9), "number_of_rows": F.lit(1), "user_metadata": F.array().cast("array<struct<item_name:string,item_value:string>>")})
    return df, spark.createDataFrame(types, "file_id bigint, type_id int, kind string, subtypes array<int>, field_names array<string>, maximum_length int, type_precision int, type_scale int")


def changes(spark, *trees):
    got = drift.schema_changes(*tree_table(spark, dict(enumerate(trees, 1))))
    return {(r["file_id"], r["change_kind"], r["field_path"]) for r in got.collect()}


def test_changes_below_a_renamed_parent(spark):
    a = {0: ("STRUCT", [1, 3], ["a", "z"]), 1: ("struct", [2], ["x"]), 2: ("INT", None, None), 3: ("DATE", [], [])}
    b = {0: ("STRUCT", [1, 4], ["b", "z"]), 1: ("STRUCT", [2, 3], ["x", "y"]), 2: ("Int", [], []), 3: ("LONG", [], []), 4: ("DATE", [], [])}
    c = {0: ("STRUCT", [1, 4], ["b", "Z"]), 1: ("STRUCT", [2, 3], ["x", "y"]), 2: ("LONG", [], []), 3: ("LONG", [], []), 4: ("DATE", [], [])}
    assert changes(spark, a, b, c) == {(2, "renamed", "b"), (2, "added", "b.y"), (3, "retyped", "b.x"), (3, "renamed", "Z")}


def test_nothing_below_a_retyped_parent_is_compared(spark):
    a = {0: ("STRUCT", [1], ["a"]), 1: ("STRUCT", [2], ["value"]), 2: ("STRUCT", [3], ["x"]), 3: ("INT", [], [])}
    b = {0: ("STRUCT", [1], ["a"]), 1: ("MAP", [2, 3], []), 2: ("INT", [], []), 3: ("STRUCT", [4], ["y"]), 4: ("INT", [], [])}
    assert changes(spark, a, b) == {(2, "retyped", "a")}
    assert changes(spark, a, {0: ("LIST", [1], []), 1: ("INT", [], [])}) == set()


def test_unions_change_by_variant_and_fields_come_back(spark):
    a = {0: ("STRUCT", [1], ["u"]), 1: ("UNION", [2, 3], []), 2: ("INT", [], []), 3: ("LONG", [], [])}
    b = {0: ("STRUCT", [1], ["u"]), 1: ("UNION", [2], []), 2: ("LONG", [], [])}
    assert changes(spark, a, b, a) == {(2, "removed", "u.v1"), (2, "retyped", "u.v0"), (3, "added", "u.v1"), (3, "retyped", "u.v0")}
    spans = drift.lifespans(*tree_table(spark, {1: a, 2: b, 3: a}))
    assert sorted((r["field_path"], r["kind"], r["first_version"], r["last_version"]) for r in spans.collect() if r["field_path"] == "u.v1") == [("u.v1", "LONG", 1, 1), ("u.v1", "LONG", 3, 3)]


def test_casts_follow_renames(spark):
    a = {0: ("STRUCT", [1], ["a"]), 1: ("INT", [], [])}
    b = {0: ("STRUCT", [1], ["b"]), 1: ("INT", [], [])}
    c = {0: ("STRUCT", [1], ["b"]), 1: ("LONG", [], [])}
    plan = drift.cast_plan(*tree_table(spark, {1: a, 2: b, 3: c})).collect()
    assert {(r["canonical"], r["field_path"], r["target_kind"]) for r in plan} == {("a", "a", "LONG"), ("a", "b", "LONG")}
    assert drift.common_kind(["INT", "DOUBLE"]) == "DOUBLE" and drift.common_kind(["DATE", "INT"]) == "STRING" and drift.common_kind(["LIST", "INT"]) == "VARIANT"


def test_lineages_and_casts_at_any_depth(spark, t):
    a = {0: ("STRUCT", [1, 2], ["a", "s"]), 1: ("INT", [], []), 2: ("STRUCT", [3], ["x"]), 3: ("INT", [], [])}
    b = {0: ("STRUCT", [1, 2], ["b", "s"]), 1: ("INT", [], []), 2: ("STRUCT", [3], ["y"]), 3: ("INT", [], [])}
    c = {0: ("STRUCT", [1, 2, 4], ["b", "s", "a"]), 1: ("LONG", [], []), 2: ("STRUCT", [3], ["y"]), 3: ("DOUBLE", [], []), 4: ("STRING", [], [])}
    files, types = tree_table(spark, {1: a, 2: b, 3: c})
    plan = {(r["canonical"], r["field_path"], r["target_kind"]) for r in drift.cast_plan(files, types).collect()}
    assert plan == {("a", "a", "LONG"), ("a", "b", "LONG"), ("a@3", "a", "STRING"), ("s", "s", "STRUCT"), ("s.x", "s.x", "DOUBLE"), ("s.x", "s.y", "DOUBLE")}
    rows = [(1, 1, '{"a": 1, "s": {"x": 5}}'), (2, 3, '{"b": 2, "s": {"y": 0.5}, "a": "new"}'), (3, 3, '{"b": "odd"}'), (4, 3, '{"b"')]
    nested = spark.createDataFrame(rows, "row_id bigint, file_id bigint, payload string").selectExpr("*", "timestamp_ntz'2020-01-01' as ingested_at")
    got = drift.unified_fields(files, types, nested, t["row_records"].limit(0)).collect()
    assert {(r["row_id"], r["field"], r["value"], r["fits"]) for r in got if r["value"]} == {
        (1, "a", "1", True), (1, "s", '{"x": 5.0}', True), (2, "a", "2", True), (2, "s", '{"x": 0.5}', True), (2, "a@3", "new", True), (3, "a", "odd", False)
    }


def test_flat_rows_are_unified(t):
    got = drift.unified_fields(*(t[n] for n in ("orc_files", "file_types", "nested_rows", "row_records")))
    flat = got.where("source = 'flat'").select("row_id").distinct().count()
    assert flat == t["row_records"].join(t["file_types"].select("file_id").distinct(), "file_id").select("record_id").distinct().count()


TREE = [
    {"type_id": i, "kind": k, "subtypes": s, "field_names": n}
    for i, (k, s, n) in enumerate([("STRUCT", [1, 3, 6, 9], ["l", "m", "u", "b"]), ("LIST", [2], []), ("INT", [], []), ("MAP", [4, 5], []), ("STRING", [], []), ("LIST", [10], []), ("UNION", [7, 8], []), ("INT", [], []), ("STRING", [], []), ("BINARY", [], []), ("STRUCT", [11], ["x"]), ("INT", [], [])])
]


@pytest.mark.parametrize(
    "value, expected",
    [
        ({}, []),
        ({"l": []}, []),
        ({"l": [1, None]}, [("$", "$.l[0]"), ("$", "$.l[1]")]),
        ({"l": 5}, [("$", "$.l[0]")]),
        ({"l": "[1]", "b": [1, 2]}, [("$", "$.l[0]")]),
        ({"u": {"tag": 1, "value": None}}, [("$", "$.u")]),
        ({"u": {"tag": 9, "value": 3}}, [("$", "$.u")]),
        ({"m": [{"key": None, "value": [{"x": 1}, None]}, {"key": "a"}]}, [("$", "$.m[0]"), ("$.m[0]", "$.m[0].value[0]"), ("$.m[0]", "$.m[0].value[1]"), ("$", "$.m[1]")]),
        ({"m": {"k": []}}, [("$", "$.m[0]")]),
    ],
)
def test_levels_give_the_children(value, expected):
    root, leaves = shredding.plan_tree(TREE)
    levels = [[(r, d) for r, d, _ in c] for c in shredding.shred(root, leaves, value)]
    assert sorted(shredding.children_of(root, levels)) == sorted(expected)


def test_flat_tables_hold_values_and_parents(spark):
    types = spark.createDataFrame([(1, *x.values()) for x in TREE], "file_id bigint, type_id int, kind string, subtypes array<int>, field_names array<string>")
    payload = {"l": [7, None], "m": [{"key": "a", "value": [{"x": 1}, None, {"x": None}]}, {"key": None, "value": []}], "u": {"tag": 1, "value": "w"}, "b": [1, 2]}
    rows = [(5, 1, json.dumps(payload)), (6, 1, "{}"), (7, 1, '{"l":'), (8, 1, None), (9, 2, "{}")]
    df = spark.createDataFrame(rows, "row_id bigint, file_id bigint, payload string").withColumn("ingested_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    got = sorted((r["row_id"], r["table"], r["parent_path"], r["child_path"], r["columns"]) for r in shredding.flat_tables(df, types).collect() if r["parent_path"] is not None)
    assert got == [
        (5, "$.l[]", "$", "$.l[0]", {"": "7"}), (5, "$.l[]", "$", "$.l[1]", {}),
        (5, "$.m[]", "$", "$.m[0]", {"key": "a"}), (5, "$.m[]", "$", "$.m[1]", {}),
        (5, "$.m[].value[]", "$.m[0]", "$.m[0].value[0]", {"x": "1"}), (5, "$.m[].value[]", "$.m[0]", "$.m[0].value[1]", {}), (5, "$.m[].value[]", "$.m[0]", "$.m[0].value[2]", {}),
        (5, "$.u", "$", "$.u", {"value<v1>": "w"}),
    ]
    assert {(r["row_id"], str(r["columns"])) for r in shredding.flat_tables(df, types).where("parent_path is null").collect()} == {(5, "{'b': '[1, 2]'}"), (6, "{}")}
    levels = {(r["leaf_path"], r["ordinal"]): (r["rep"], r["def"], r["value"]) for r in shredding.leaf_values(shredding.shredded(df, types)).where("row_id = 5").collect()}
    assert levels["$.l[]", 0] == (0, 3, "7") and levels["$.l[]", 1] == (1, 2, None) and levels["$.m[].value[].x", 3] == (1, 3, None)


def test_tables_keep_every_value(spark, t):
    """Each present leaf value is in exactly one row of one table, and every row but the records names a row that is there."""
    levels = shredding.leaf_values(shredding.shredded(t["nested_rows"], t["file_types"])).where("value is not null")
    rows = [r.asDict() for r in shredding.flat_tables(t["nested_rows"], t["file_types"]).collect()]
    held = sorted((r["row_id"], v) for r in rows for v in r["columns"].values() if v is not None)
    assert held == sorted((r["row_id"], r["value"]) for r in levels.collect())
    there = {(r["row_id"], r["child_path"]) for r in rows}
    assert len(there) == len(rows) and all((r["row_id"], r["parent_path"]) in there for r in rows if r["parent_path"] is not None)


def test_bad_trees_and_payloads_give_no_rows():
    assert shredding.plan_tree([{"type_id": 1, "kind": "INT", "subtypes": [], "field_names": []}]) is None
    assert shredding.plan_tree([{"type_id": 0, "kind": "LIST", "subtypes": [0], "field_names": []}]) is None
    assert [shredding.complete_json(x) for x in (None, "", '{"a": 1', "NaN x")] == [None] * 4
    assert shredding.complete_json("[NaN]") is not None


def near(rows):
    return {(*r[:7], round(r[7], 6) if r[7] is not None else None, r[8]) for r in rows}


def test_hot_loads_are_split_without_a_difference(spark, t, monkeypatch):
    whole = near(profile.profile(t["row_records"]).collect())
    monkeypatch.setattr(profile, "PIECE_ROWS", 50)
    assert whole == near(profile.profile(t["row_records"]).collect())


def test_large_loads(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, 1).otherwise(F.col("id")).cast("bigint").alias("file_id"))
    assert [tuple(r) for r in profile.large_loads(rows, 1_000).collect()] == [(1, 2)]


def test_value_counts_are_kept_and_taken_back(spark, t):
    store = profile.ValueCounts(spark)
    one = profile.deltas(t["row_records"], list(profile.COLUMNS))
    store.apply("a", one)
    store.apply("a", one)
    assert near(profile.figures(store.counts()).collect()) == near(profile.profile(t["row_records"]).collect())
    store.apply("back", one.withColumn("delta", -F.col("delta")))
    assert store.counts().count() == 0


def test_a_later_delivery_and_a_retraction_give_the_fresh_profile(spark, t):
    names = list(profile.COLUMNS)
    rows = t["row_records"].where("record_id is not null").dropDuplicates(["record_id"])
    later = rows.where("pmod(record_id, 7) = 0").withColumns({"ingested_at": F.lit("2100-01-01").cast("timestamp_ntz"), "c_int": F.col("c_int") + 1, "c_str": F.lit("new")})
    load = rows.agg(F.max("file_id")).first()[0]
    store = profile.ValueCounts(spark)
    store.apply("first", profile.deltas(rows, names))
    store.apply("later", profile.deltas(later, names).unionByName(profile.deltas(rows.where("pmod(record_id, 7) = 0"), names).withColumn("delta", -F.col("delta"))))
    both = rows.unionByName(later)
    assert near(profile.figures(store.counts()).collect()) == near(profile.profile(both).collect())
    taken = profile.deltas(both.where(F.col("file_id") == load), names)
    store.apply("back", taken.withColumn("delta", -F.col("delta")))
    assert near(profile.figures(store.counts()).collect()) == near(profile.profile(both.where(F.col("file_id") != load)).collect())


def test_medians(spark):
    rows = [(1, 3, v, None, None, None, k) for v, k in ((-5, 2), (0, 1), (7, 4), (10**12, 1))] + [(2, 6, None, v, None, None, 1) for v in (-1e9, 0.25, 0.5, 3e8)]
    rows += [(f, 6, None, float(v), None, None, k) for f, v, k in ((3, "nan", 1), (3, "inf", 1), (3, "1", 1), (4, "-inf", 1), (4, "-1", 1), (4, "inf", 1), (5, "nan", 2), (5, "inf", 1))]
    df = spark.createDataFrame(rows, "file_id bigint, c int, l bigint, d double, n decimal(18,4), s string, count bigint")
    assert {r["file_id"]: str(r["median"]) for r in profile.medians(df).collect()} == {1: "7.0", 2: "0.375", 3: "inf", 4: "-1.0", 5: "nan"}


def test_plan_cuts_at_the_target(spark, t):
    plan = compaction.compaction_plan(t["orc_files"], t["stripes"], target=3_000).collect()
    sizes = {}
    for r in plan:
        sizes.setdefault((r["feed_id"], r["day"], r["container"]), []).append(r["data_bytes"])
    assert all(sum(v) - v[-1] < 3_000 + max(v) for v in sizes.values())
    assert {r["file_id"] for r in plan} == {r["file_id"] for r in compaction.compaction_plan(t["orc_files"], t["stripes"]).collect()}


def test_tiny_files_do_not_gather_without_bound(spark, t, monkeypatch):
    monkeypatch.setattr(compaction, "MOST_FILES", 2)
    held = {}
    for r in compaction.compaction_plan(t["orc_files"], t["stripes"]).collect():
        held.setdefault((r["feed_id"], r["day"], r["container"]), []).append((r["offset"], r["data_bytes"]))
    assert max(map(len, held.values())) == 2
    for files in held.values():
        ends = [0, *[o + n for o, n in sorted(files)]]
        assert [o for o, _ in sorted(files)] == ends[:-1]


def test_joined_files_hold_every_row_once(spark, t):
    import zstandard

    plan = compaction.compaction_plan(t["orc_files"], t["stripes"])
    for form in ("zstd", "lines"):
        done = compaction.joined_files(plan, t["row_records"], t["nested_rows"], form, keep=True).collect()
        assert done and all(r["intact"] for r in done) and sum(r["records"] for r in done) > 0
        ids = []
        for path in {r["container_path"] for r in done}:
            with open(path.removeprefix("file://"), "rb") as f:
                data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() if form == "zstd" else f.read()
            ids += [(x.get("record_id"), x.get("row_id")) for x in map(json.loads, data.decode().splitlines())]
        files = {r["file_id"] for r in done}
        expected = {(r["record_id"], None) for r in t["row_records"].collect() if r["file_id"] in files} | {(None, r["row_id"]) for r in t["nested_rows"].collect() if r["file_id"] in files}
        assert len(ids) == len(set(ids)) and set(ids) == expected


def test_a_damaged_byte_is_noticed(spark, tmp_path):
    import zlib

    import zstandard

    bodies = [b"a\n", b"b\nc", b""]
    schema = "target_path string, ordinal int, source_path string, length bigint, crc bigint"
    for form in ("lines", "zstd"):
        data = [zstandard.ZstdCompressor().compress(b) if form == "zstd" else b for b in bodies]
        plan = [(f"{tmp_path}/{form}/all", i, f"{tmp_path}/{form}/{i}", len(x), zlib.crc32(x)) for i, x in enumerate(data)]
        for (_, _, path, _, _), x in zip(plan, data):
            files.put(path, x)
        r = compaction.compact_paths(spark.createDataFrame(plan, schema), form).first()
        assert r["intact"] and r["bytes"] == (6 if form == "lines" else sum(map(len, data)))
        (tmp_path / form / "all").unlink()
        worse = {"changed": data[1][:-1] + bytes([data[1][-1] ^ 1]), "short": data[1][:-1], "long": data[1] + b"\n"}
        for how, x in worse.items():
            (tmp_path / form / "1").write_bytes(x)
            r = compaction.compact_paths(spark.createDataFrame(plan, schema), form).first()
            assert not r["intact"] and r["fault"] and sorted(f.name for f in (tmp_path / form).iterdir()) == ["0", "1", "2"], how


def test_frames_are_measured_and_joined():
    import zstandard

    a = zstandard.ZstdCompressor(write_checksum=True).compress(b"one" * 50_000)
    b = zstandard.ZstdCompressor(write_content_size=False).compress(b"")
    c = zstandard.ZstdCompressor(level=19).compress(bytes(range(256)) * 2_000)
    skip = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    assert compaction.frame_lengths(a + b + skip + c) == [len(a), len(b), len(skip), len(c)]
    whole = a + b + c
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"one" * 50_000 + bytes(range(256)) * 2_000
    for bad in (a[:-1], a[:6], b"junk-junk-junk"):
        with pytest.raises(ValueError):
            compaction.frame_lengths(bad)


def test_files_join_on_disk(spark, tmp_path):
    for i, body in enumerate((b"h\n1\n2", b"h\n", b"h\n3\n4\n")):
        (tmp_path / f"{i}.csv").write_bytes(body)
    plan = spark.createDataFrame([(f"{tmp_path}/out/all.csv", i, f"{tmp_path}/{i}.csv", None, None) for i in range(3)], "target_path string, ordinal int, source_path string, length bigint, crc bigint")
    r = compaction.compact_paths(plan, "lines", b"h\n").first()
    assert r["intact"] and r["files"] == 3 and (tmp_path / "out/all.csv").read_bytes() == b"h\n1\n2\n3\n4\n" and len(list((tmp_path / "out").iterdir())) == 1


def read(spark, text, zone="UTC", order=None, **policy):
    files = spark.createDataFrame([(1, [("date.order", order)] if order else None)], "file_id bigint, user_metadata array<struct<item_name:string,item_value:string>>")
    files = files.withColumns({c: F.lit(None).cast(k) for c, k in (("feed_id", "bigint"), ("dataset", "string"), ("file_path", "string"), ("file_layout", "string"), ("written_at", "timestamp_ntz"), ("registered_at", "timestamp_ntz"), ("body_digest", "string"), ("content_length", "bigint"), ("number_of_rows", "bigint"))})
    st = spark.createDataFrame([(1, 0, zone)], "file_id bigint, stripe_no int, writer_timezone string")
    rows = spark.createDataFrame([(i, 1, 0, None, None, x) for i, x in enumerate(text)], "record_id bigint, file_id bigint, stripe_no int, ingested_at timestamp_ntz, c_ts struct<seconds:bigint,nanos:bigint>, c_ts_text string")
    got = {r["record_id"]: r["utc_us"] for r in instants.instants(rows, st, files, **policy).collect()}
    return [got.get(i) for i in range(len(text))]


def us(*args):
    return int((dt.datetime(*args) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def test_forms(spark):
    moment = us(2021, 7, 9, 8, 7, 6)
    same = ["2021-07-09 08:07:06", "2021-07-09T08:07:06Z", "20210709T080706Z", "20210709080706", "2021-190T08:07:06", "  2021.07.09 08:07:06 ", "July 9, 2021 8:07:06 AM", "09-JUL-2021 08:07:06 utc", "9/7/2021 8:07:06", "1625818026", "1625818026000", "1625818026000000", "1625818026000000000", "1625818026.0", "2021-07-09t13:37:06+0530", "2021-07-09 04:07:06 america/new_york", "2021-07-09T17:07:06[Asia/Tokyo]", "2021-07-09T10:07:06+02"]
    assert read(spark, same, order="dmy") == [moment] * len(same)
    bad = ["", " ", "n/a", "2021-02-29 00:00:00", "2021-366T00:00:00", "2021-13-01 00:00:00", "2021-01-01 24:00:00", "2021-01-01 00:60:00", "13:00:00", "July 9, 2021 13:07:06 AM", "31/31/2022 01:00:00", "2021-07-09 08:07:06 Mars/Base", None]
    assert read(spark, bad, order="dmy") == [None] * len(bad)
    assert read(spark, ["9/7/2021 8:07:06"]) == [None]
    assert read(spark, ["2021-07-09 08:07:06.1234567", "1625818026.9999999", "-0.0000001"]) == [moment + 123_456, moment + 999_999, -1]


def test_clock_changes(spark):
    twice, never = "2021-10-31 02:30:00", "2021-03-28 02:30:00"
    assert read(spark, [twice, never], " europe/BERLIN ") == [us(2021, 10, 31, 0, 30), us(2021, 3, 28, 1, 30)]
    assert read(spark, [twice, never], "Europe/Berlin", ambiguous="last", nonexistent="null") == [us(2021, 10, 31, 1, 30), None]
    assert read(spark, [twice, never], "Europe/Berlin", ambiguous="null") == [None, us(2021, 3, 28, 1, 30)]
    assert read(spark, [twice], None) == [us(2021, 10, 31, 2, 30)] and read(spark, [twice], "Nowhere/Land") == [None]
    assert read(spark, ["2021-01-01 00:00:00"], "UTC+02:00") == [us(2020, 12, 31, 22)] and read(spark, ["2021-01-01 00:00:00"], "Etc/GMT-3") == [us(2020, 12, 31, 21)]
