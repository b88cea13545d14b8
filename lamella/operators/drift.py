"""Schemas that drift between the files of a feed: a catalogue of column lifespans, its log of changes, and casts into one table.

Method. A lag over the files of a feed finds those whose type tree differs from the one before; each begins a new version, and the trees of the versions
are exploded into (feed, version, path, kind). The versions in which a path has a kind fall into islands without a gap (version less rank is the same all
through one): the catalogue of lifespans. Its starts and endings, logged under the file at which they happen, are the raw changes; where an ending and a
start of one kind meet at one ordinal, they are an alias (a rename), and what lies below an alias is compared under the new name.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.ordered import split_lag, split_sum
from lamella.operators.profile import large_loads
from lamella.operators.registry import registered_files
from lamella.session import written

#: Joins the names of a path inside the operator, as a name may itself contain a dot.
STEP = "\x01"
#: Versions in one block of the second-level windows.
BLOCK = 512

TREE = "array<struct<type_id:int,kind:string,subtypes:array<int>,field_names:array<string>>>"


def type_trees(file_types: DataFrame) -> DataFrame:
    """One row per file: its type nodes in order, kinds in upper case, absent arrays empty, repeated rows once. A footer bounds the array."""
    node = F.struct(
        F.col("type_id").cast("int").alias("type_id"),
        F.upper(F.trim("kind")).alias("kind"),
        F.coalesce(F.col("subtypes").cast("array<int>"), F.array().cast("array<int>")).alias("subtypes"),
        F.coalesce("field_names", F.array().cast("array<string>")).alias("field_names"),
    )
    rows = file_types.where("file_id is not null and type_id is not null").select("file_id", node.alias("node"))
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_set("node")).alias("tree"))


def child_names(kind: str, subtypes, field_names) -> list[str]:
    """What the children of a node are called: fields by name, others by their part."""
    n = len(subtypes)
    if kind == "STRUCT":
        names = ["" if x is None else x for x in field_names]
        return [names[i] if i < len(names) else f"_{i}" for i in range(n)]
    if kind == "LIST":
        return ["item", *[f"item{i}" for i in range(1, n)]][:n]
    if kind == "MAP":
        return ["key", "value", *[f"part{i}" for i in range(2, n)]][:n]
    return [f"v{i}" for i in range(n)]


def paths_of(tree) -> list[tuple[str, str, str, int, str, str]]:
    """(path, parent path, name, ordinal, kind, parent's kind) of every node; of equal names in one struct the first counts."""
    nodes = {}
    for x in tree:
        nodes.setdefault(x["type_id"], x)
    if 0 not in nodes:
        return []
    out, seen = [("", "", "", 0, nodes[0]["kind"] or "", "")], {0}
    todo = [(0, "")]
    while todo:
        at, path = todo.pop()
        x = nodes[at]
        taken = set()
        for i, (name, sub) in enumerate(zip(child_names(x["kind"], x["subtypes"], x["field_names"]), x["subtypes"])):
            if name in taken or sub not in nodes or sub in seen:
                continue
            taken.add(name)
            seen.add(sub)
            below = path + STEP + name
            out.append((below, path, name, i, nodes[sub]["kind"] or "", x["kind"] or ""))
            todo.append((sub, below))
    return out


NODES = "feed_id bigint, version bigint, file_id bigint, path string, parent string, name string, ordinal int, kind string, parent_kind string"


def _explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(f, v, i, *p) for f, v, i, t in zip(part["feed_id"], part["version"], part["file_id"], part["tree"]) for p in paths_of(t)]
        yield pd.DataFrame(rows, columns=["feed_id", "version", "file_id", "path", "parent", "name", "ordinal", "kind", "parent_kind"])


def _numbered(orc_files: DataFrame, trees: DataFrame) -> DataFrame:
    """file_id, feed_id, written_at, changed, version of every file with type rows."""
    files = registered_files(orc_files).select("file_id", "feed_id", "written_at")
    day = F.coalesce(F.to_date("written_at"), F.lit("0001-01-01").cast("date"))
    slim = written(files.join(trees.select("file_id", "print"), "file_id"), "prints")
    slim = split_lag(slim, ["feed_id"], ["written_at", "file_id"], day, {"print_before": "print"})
    slim = slim.withColumn("changed", (~F.col("print").eqNullSafe(F.col("print_before"))).cast("int"))
    counted = split_sum(slim, ["feed_id"], ["written_at", "file_id"], day, "changed", "earlier")
    return counted.select("file_id", "feed_id", "written_at", "changed", (F.col("earlier") + F.col("changed")).alias("version"))


def _trees(file_types: DataFrame) -> DataFrame:
    return written(type_trees(file_types).withColumn("print", F.xxhash64(F.to_json("tree"))), "trees")


def versions(orc_files: DataFrame, file_types: DataFrame) -> DataFrame:
    """The files at which a feed's tree changes (its first file among them), numbered from 1 in each feed by written_at, then file_id.

    Files without type rows take no part. Each file_id counts once.
    """
    trees = _trees(file_types)
    fresh = _numbered(orc_files, trees).where("changed = 1").select("feed_id", "version", "file_id", "written_at")
    return fresh.join(trees.select("file_id", "tree"), "file_id").select("feed_id", "version", "file_id", "written_at", "tree")


def nodes_of(of: DataFrame) -> DataFrame:
    """The exploded footers of `versions`."""
    return of.select("feed_id", "version", "file_id", "tree").mapInPandas(_explode, NODES)


def catalogue(of: DataFrame) -> DataFrame:
    """The lifespans of `versions`: feed_id, path, parent, name, kind, and first and last (version, file_id, ordinal, parent_kind) of each island."""
    nodes = written(nodes_of(of).withColumn("one", F.lit(1)), "nodes")
    ranked = split_sum(nodes, ["feed_id", "path", "kind"], ["version"], F.expr(f"version div {BLOCK}"), "one", "rank")
    end = F.struct("version", "file_id", "ordinal", "parent_kind")
    spans = ranked.groupBy("feed_id", "path", "parent", "name", "kind", (F.col("version") - F.col("rank")).alias("island")).agg(F.min(end).alias("first"), F.max(end).alias("last"))
    return spans.drop("island")


def lifespans(orc_files: DataFrame, file_types: DataFrame) -> DataFrame:
    """The catalogue: feed_id, field_path, kind, first_version, last_version, first_file_id, one row per island of consecutive versions."""
    spans = catalogue(versions(orc_files, file_types)).where("path <> ''")
    path = F.translate(F.substring("path", 2, 1 << 30), STEP, ".")
    return spans.select("feed_id", path.alias("field_path"), "kind", F.col("first.version").alias("first_version"), F.col("last.version").alias("last_version"), F.col("first.file_id").alias("first_file_id"))


CHANGES = "feed_id bigint, version bigint, file_id bigint, change_kind string, field_path string, old_path string, kind string, old_kind string"


def compare(events) -> list[tuple[str, str, str, str, str]]:
    """(change, later path, earlier path, later kind, earlier kind) from the starts and endings between two consecutive versions."""
    ended: dict[str, dict] = {}
    started: dict[str, dict] = {}
    touched = set()
    for e in events:
        touched.add(e["path"])
        (ended if e["side"] == "end" else started).setdefault(e["parent"], {})[e["name"]] = e
    root = "" in touched and any(e["path"] == "" for e in events)
    out: list[tuple[str, str, str, str, str]] = []
    if root:
        return out

    def lineage(path: str) -> list[str]:
        parts = path.split(STEP)
        return [STEP.join(parts[:k]) for k in range(1, len(parts) + 1)]

    todo = [(p, p) for p in sorted({*ended, *started}) if not any(a in touched for a in lineage(p))]
    while todo:
        old_parent, new_parent = todo.pop()
        a = {n: e for n, e in ended.get(old_parent, {}).items()}
        b = {n: e for n, e in started.get(new_parent, {}).items()}
        for n in sorted(a.keys() & b.keys()):
            x, y = a.pop(n), b.pop(n)
            if x["kind"] == y["kind"]:
                todo.append((x["path"], y["path"]))
            else:
                out.append(("retyped", new_parent + STEP + n, x["path"], y["kind"], x["kind"]))
        there = {(e["ordinal"], e["kind"]): n for n, e in b.items() if e["parent_kind"] == "STRUCT"}
        for n in sorted(a):
            x = a[n]
            m = there.get((x["ordinal"], x["kind"])) if x["parent_kind"] == "STRUCT" else None
            if m is None:
                out.append(("removed", new_parent + STEP + n, x["path"], "", x["kind"]))
            else:
                y = b.pop(m)
                out.append(("renamed", new_parent + STEP + m, x["path"], y["kind"], x["kind"]))
                todo.append((x["path"], y["path"]))
        for n in sorted(b):
            out.append(("added", new_parent + STEP + n, "", b[n]["kind"], ""))
    return out


def _resolve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    dotted = lambda p: p[1:].replace(STEP, ".")
    for part in parts:
        rows = [
            (f, v, i, c, dotted(new), dotted(old), k, j)
            for f, v, i, events in zip(part["feed_id"], part["version"], part["file_id"], part["events"])
            for c, new, old, k, j in compare(events)
        ]
        yield pd.DataFrame(rows, columns=["feed_id", "version", "file_id", "change_kind", "field_path", "old_path", "kind", "old_kind"])


def schema_changes(orc_files: DataFrame, file_types: DataFrame) -> DataFrame:
    """Every change between a file and the one before it in its feed.

    Rows: feed_id, version, file_id (of the later file), change_kind (added, removed, renamed, retyped), field_path as in the later file, old_path,
    kind, old_kind (empty where there is none). Names are case-sensitive, kinds are not. Where the root's kind changes nothing below is compared.
    Empty tables give no rows; null feeds form one feed; files without type rows are passed over.
    """
    seen = written(versions(orc_files, file_types), "versions")  # read for the catalogue and for the files
    event = lambda side, at: F.struct(F.lit(side).alias("side"), "path", "parent", "name", f"{at}.ordinal", "kind", f"{at}.parent_kind")
    start = F.when(F.col("first.version") > 1, F.struct(F.col("first.version").alias("version"), event("start", "first").alias("event")))
    ending = F.struct((F.col("last.version") + 1).alias("version"), event("end", "last").alias("event"))
    log = catalogue(seen).select("feed_id", F.explode(F.array_compact(F.array(start, ending))).alias("x")).select("feed_id", "x.version", "x.event")
    # the events of one version are bounded by two footers
    log = log.groupBy("feed_id", "version").agg(F.collect_list("event").alias("events"))
    at = seen.select(F.col("feed_id").alias("_feed"), F.col("version").alias("_version"), "file_id")
    log = log.join(at, log["feed_id"].eqNullSafe(at["_feed"]) & (log["version"] == at["_version"]))
    return log.select("feed_id", "version", "file_id", "events").mapInPandas(_resolve, CHANGES)


#: Kinds that hold every value of both, from narrow to wide: fixed values.
WIDER = {
    **{(a, b): b for chain in (("BOOLEAN", "BYTE", "SHORT", "INT", "LONG", "DECIMAL"), ("FLOAT", "DOUBLE"), ("CHAR", "VARCHAR", "STRING"), ("DATE", "TIMESTAMP")) for i, a in enumerate(chain) for b in chain[i:]},
    **{(a, "DOUBLE"): "DOUBLE" for a in ("BOOLEAN", "BYTE", "SHORT", "INT")},
}
#: The type that a kind is cast to in the consistent table: fixed values.
CAST = {"BOOLEAN": "boolean", "BYTE": "smallint", "SHORT": "smallint", "INT": "int", "LONG": "bigint", "DECIMAL": "decimal(38,18)", "FLOAT": "float", "DOUBLE": "double", "CHAR": "string", "VARCHAR": "string", "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BINARY": "binary"}
COMPOSITE = ("STRUCT", "LIST", "MAP", "UNION")


def common_kind(kinds: list[str]) -> str:
    """The narrowest kind that holds values of all `kinds`; STRING where there is none, VARIANT where composites differ."""
    left = sorted({k for k in kinds if k})
    if not left:
        return "STRING"
    if any(k in COMPOSITE for k in left):
        return left[0] if len(left) == 1 else "VARIANT"
    at = left[0]
    for k in left[1:]:
        at = WIDER.get((at, k)) or WIDER.get((k, at)) or "STRING"
    return at


ALIASES = "feed_id bigint, canonical string, field_path string, kinds array<string>, target_kind string, cast_sql string, first_version bigint, last_version bigint, kind string, path string, canonical_path string"


def lineages(trees: Iterable[tuple[int, list]]) -> list[tuple[str, str, str, int, int]]:
    """(canonical path, path, kind, first version, last version) from the trees of one feed in order.

    A field keeps its canonical name, the first it had below its parent, through renames and retypes; one that was removed and comes back under its last
    name is the same field. Another field whose name is taken gets its first version as a suffix.
    """
    canonical: dict[int, str] = {}
    taken: set[str] = set()
    gone: dict[tuple[int, str], int] = {}
    now: dict[str, int] = {}
    spans: dict[tuple[str, int, str], list[list[int]]] = {}
    before: dict[str, tuple] = {}
    for version, tree in trees:
        nodes = {x[0]: x for x in paths_of(tree)}
        below: dict[str, list[str]] = {}
        for x in nodes.values():
            if x[0]:
                below.setdefault(x[1], []).append(x[0])
        old_below: dict[str, list[str]] = {}
        for x in before.values():
            if x[0]:
                old_below.setdefault(x[1], []).append(x[0])
        new: dict[str, int] = {"": 0}
        todo = [("", "" if "" in before and "" in nodes and before[""][4] == nodes[""][4] else None)] if "" in nodes else []
        kept: set[int] = set()
        fresh: list[str] = []
        while todo:
            path, old = todo.pop()
            a = {before[p][2]: before[p] for p in old_below.get(old, [])} if old is not None else {}
            b = {nodes[p][2]: nodes[p] for p in below.get(path, [])}
            pairs = [(b[n], a[n]) for n in b if n in a]
            lost = {(x[3], x[4]): x for n, x in a.items() if n not in b and x[5] == "STRUCT"}
            for n in b.keys() - a.keys():
                y = b[n]
                x = lost.pop((y[3], y[4]), None) if y[5] == "STRUCT" else None
                pairs.append((y, x))
            for y, x in pairs:
                if x is None:
                    fresh.append(y[0])
                else:
                    new[y[0]] = now[x[0]]
                    kept.add(now[x[0]])
                todo.append((y[0], x[0] if x is not None and x[4] == y[4] else None))
        for p, x in before.items():
            if p and now[p] not in kept and x[1] in now:
                gone[now[x[1]], x[2]] = now[p]
        for p in sorted(fresh, key=lambda p: (p.count(STEP), nodes[p][3], p)):  # parents first
            parent, name = new[nodes[p][1]], nodes[p][2]
            back = gone.pop((parent, name), None)
            if back is None:
                back = len(canonical) + 1
                called = canonical.get(parent, "") + STEP + name
                while called in taken:
                    called += f"@{version}"
                taken.add(called)
                canonical[back] = called
            new[p] = back
        for p, x in nodes.items():
            if p:
                seen = spans.setdefault((p, new[p], x[4]), [])
                if seen and seen[-1][1] == version - 1:
                    seen[-1][1] = version
                else:
                    seen.append([version, version])
        now, before = new, nodes
    return [(canonical[i], p, k, a, b) for (p, i, k), all_ in spans.items() for a, b in all_]


def _aliases(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The alias rows of feeds whose versions come one after another, in order. Of a feed only its fields and their spans are kept, not its trees."""
    trees = ((None if pd.isna(f) else int(f), v, t) for part in parts for f, v, t in zip(part["feed_id"], part["version"], part["tree"]))
    dotted = lambda p: p[1:].replace(STEP, ".")
    quoted = lambda p: ".".join("`" + x.replace("`", "``") + "`" for x in p[1:].split(STEP))
    for feed, own in groupby(trees, key=lambda x: x[0]):
        spans = lineages((v, t) for _, v, t in own)
        kinds: dict[str, set] = {}
        for root, _, kind, _, _ in spans:
            kinds.setdefault(root, set()).add(kind)
        rows = []
        for root, path, kind, first, last in spans:
            target = common_kind(sorted(kinds[root]))
            cast = f"CAST({quoted(path)} AS {CAST[target]})" if target in CAST else quoted(path)
            alias = "`" + root.split(STEP)[-1].replace("`", "``") + "`"
            rows.append((feed, dotted(root), dotted(path), sorted(kinds[root]), target, f"{cast} AS {alias}", first, last, kind, path, root))
        out = pd.DataFrame(rows, columns=["feed_id", "canonical", "field_path", "kinds", "target_kind", "cast_sql", "first_version", "last_version", "kind", "path", "canonical_path"])
        yield out.astype({"feed_id": "Int64"})


def _plan(seen: DataFrame) -> DataFrame:
    """The aliases of every feed. A feed's versions stream through one task in order; what that task holds is bounded by the feed's fields."""
    tree = seen.select("feed_id", "version", "tree").repartition("feed_id").sortWithinPartitions("feed_id", "version")
    return tree.mapInPandas(_aliases, ALIASES)


def cast_plan(orc_files: DataFrame, file_types: DataFrame) -> DataFrame:
    """For each feed, field at any depth and interval of versions: its canonical name (the first of its lineage), the kinds seen, one kind that holds
    them, and the cast. Below a LIST, MAP or UNION the cast names the part of the element, as in item, key, value or v0."""
    return _plan(versions(orc_files, file_types)).drop("kind", "path", "canonical_path")


class Number(str):
    """A number as it is written."""


def json_text(v) -> str:
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(json_text, v)) + "]"
    return str(v) if isinstance(v, Number) else json.dumps(v, ensure_ascii=False)


def cast_leaf(v, target: str):
    """(value as the target kind asks, whether it fits); one that doesn't fit stays as it is."""
    number = isinstance(v, (int, Number)) and not isinstance(v, bool)
    if v is None or target == "VARIANT":
        return v, True
    if target in ("STRING", "VARCHAR", "CHAR"):
        return v if isinstance(v, str) and not number else json_text(v), True
    if target == "BOOLEAN":
        return v, isinstance(v, bool)
    if target in ("BYTE", "SHORT", "INT", "LONG", "DECIMAL", "FLOAT", "DOUBLE"):
        if isinstance(v, bool):
            return int(v), True
        if target in ("FLOAT", "DOUBLE") and number:
            return Number(repr(float(v))) if math.isfinite(float(v)) else v, True
        return v, number and (target == "DECIMAL" or not isinstance(v, Number))
    if target == "TIMESTAMP" and isinstance(v, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", v):
        return v + "T00:00:00.000000000", True
    if target in ("DATE", "TIMESTAMP"):
        return v, isinstance(v, str) and not number and bool(re.match(r"\d{4}-\d\d-\d\d", v))
    return v, target != "BINARY" or isinstance(v, list)


def consistent(v, path: str, fields: dict[str, tuple[str, str, str]], below: dict[str, list[str]]):
    """(a value with canonical member names and its leaves cast, whether all of it fits its types)."""
    _, kind, target = fields[path]
    if v is None:
        return None, True
    if kind not in COMPOSITE:
        return cast_leaf(v, target)
    if isinstance(v, str) and not isinstance(v, Number):
        try:
            v = parsed(v)
        except (ValueError, RecursionError):
            return v, False
    sub = {p.rpartition(STEP)[2]: p for p in below.get(path, [])}
    if kind == "STRUCT" and isinstance(v, dict):
        got = {fields[p][0].rpartition(STEP)[2]: consistent(v[n], p, fields, below) for n, p in sub.items() if n in v}
        return {n: x for n, (x, _) in got.items()}, all(ok for _, ok in got.values())
    if kind == "LIST" and isinstance(v, list) and "item" in sub:
        each = [consistent(x, sub["item"], fields, below) for x in v]
        return [x for x, _ in each], all(ok for _, ok in each)
    if kind == "MAP" and isinstance(v, list) and {"key", "value"} <= sub.keys() and all(isinstance(x, dict) for x in v):
        each = [(consistent(x.get("key"), sub["key"], fields, below), consistent(x.get("value"), sub["value"], fields, below)) for x in v]
        return [{"key": k[0], "value": x[0]} for k, x in each], all(k[1] and x[1] for k, x in each)
    if kind == "UNION" and isinstance(v, dict) and f"v{v.get('tag')}" in sub:
        p = sub[f"v{v['tag']}"]
        x, ok = consistent(v.get("value"), p, fields, below)
        return {"tag": v["tag"], "value": x}, ok
    return v, False


def parsed(text: str):
    return json.loads(text, parse_float=Number, parse_constant=Number)


UNIFIED = "source string, row_id bigint, feed_id bigint, field string, target_kind string, value string, fits boolean"


def _unify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows, known = [], {}
        for row_id, feed, version, payload, plan in zip(part["row_id"], part["feed_id"], part["version"], part["payload"], part["plan"]):
            try:
                value = parsed(payload or "")
            except (ValueError, RecursionError):
                continue
            if not isinstance(value, dict):
                continue
            key = (None if pd.isna(feed) else feed, version)
            if key not in known:
                fields = {x["path"]: (x["canonical_path"], x["kind"], x["target_kind"]) for x in plan}
                below: dict[str, list[str]] = {}
                for p in fields:
                    below.setdefault(p.rpartition(STEP)[0], []).append(p)
                known[key] = fields, below
            fields, below = known[key]
            for p in below.get("", []):
                x, ok = consistent(value.get(p[1:]), p, fields, below)
                text = None if x is None else str(x) if isinstance(x, str) else json_text(x)
                rows.append(("nested", row_id, key[0], fields[p][0][1:], fields[p][2], text, ok))
        yield pd.DataFrame(rows, columns=["source", "row_id", "feed_id", "field", "target_kind", "value", "fits"]).astype({"feed_id": "Int64"})


def unified_fields(orc_files: DataFrame, file_types: DataFrame, nested_rows: DataFrame, row_records: DataFrame) -> DataFrame:
    """All rows of the flat and nested files in one consistent table: source (flat, nested), row_id (or record_id), feed_id, field (canonical name),
    target_kind, value (text, cast to target_kind; null where absent), fits.

    Composite values are JSON under canonical member names, with their leaves cast. What can't be cast stays as it is written, and fits is false. c_ts
    stays on the writer's clock, as {"seconds", "nanos"}. Each id once in its file (the first delivery); payloads that are not complete JSON objects give no rows;
    members that the footer doesn't name, and rows of files without a footer, are left out.
    """
    trees = _trees(file_types)
    numbered = written(_numbered(orc_files, trees), "numbered")
    fresh = numbered.where("changed = 1").join(trees.select("file_id", "tree"), "file_id")
    plan = written(_plan(fresh), "cast-plan")
    files = numbered.select("file_id", "feed_id", "version")
    first = lambda *cols: F.min_by(F.struct(*cols), F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp_ntz"))).alias("it")
    of = plan.select(F.col("feed_id").alias("_feed"), F.explode(F.sequence("first_version", "last_version")).alias("_version"), F.struct("path", "canonical_path", "kind", "target_kind").alias("x"))
    # one tree bounds the array
    each = of.groupBy("_feed", "_version").agg(F.collect_list("x").alias("plan"))
    same = lambda a: a["feed_id"].eqNullSafe(F.col("_feed")) & (a["version"] == F.col("_version"))
    once = nested_rows.where("row_id is not null").groupBy("row_id").agg(first("file_id", "payload")).select("row_id", "it.*").join(files, "file_id")
    nested = once.join(each, same(once)).select("row_id", "feed_id", "version", "payload", "plan").mapInPandas(_unify, UNIFIED)
    columns = [c for c in row_records.columns if c.startswith("c_")]
    text = lambda c: F.to_json(c) if c == "c_ts" else F.col(c).cast("string")
    tops = of.where(f"instr(substring(x.path, 2), '{STEP}') = 0").groupBy("_feed", "_version").agg(
        F.map_from_entries(F.collect_list(F.struct(F.substring("x.path", 2, 1 << 30), F.struct(F.substring("x.canonical_path", 2, 1 << 30).alias("field"), "x.target_kind")))).alias("tops")
    )
    # rows are shuffled once: by file, a large file in pieces, which both the deliveries of a record and the fields of its file share
    large = written(large_loads(row_records), "large-loads")
    pieces = files.join(tops, same(files)).join(large, "file_id", "left").select("file_id", "feed_id", "tops", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    rows = row_records.where("record_id is not null and file_id is not null").select("file_id", "record_id", "ingested_at", *columns).join(large, "file_id", "left")
    rows = rows.withColumn("piece", F.expr("cast(pmod(xxhash64(record_id), coalesce(pieces, 1)) as int)")).drop("pieces").repartition("file_id", "piece")
    flat = rows.groupBy("file_id", "piece", "record_id").agg(first(*columns)).select("file_id", "piece", "record_id", "it.*").join(pieces, ["file_id", "piece"])
    cells = flat.select("record_id", "feed_id", "tops", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("raw")) for c in columns])).alias("cell"))
    cells = cells.select("record_id", "feed_id", "cell.*", F.expr("try_element_at(tops, cell.name)").alias("top")).where("top is not null").select("record_id", "feed_id", "name", "raw", "top.*")
    cast = F.lit(None).cast("string")
    for kind, to in CAST.items():
        if kind != "BINARY":
            cast = F.when(F.col("target_kind") == kind, F.expr(f"cast(try_cast(raw as {to}) as string)")).otherwise(cast)
    cast = F.when(F.col("name") == "c_ts", F.col("raw")).otherwise(cast)
    cells = cells.withColumn("cast", cast)
    flat = cells.select(F.lit("flat").alias("source"), F.col("record_id").alias("row_id"), "feed_id", "field", "target_kind", F.coalesce("cast", "raw").alias("value"), F.expr("raw is null or cast is not null").alias("fits"))
    return nested.unionByName(flat)
