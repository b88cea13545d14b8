"""Deeply nested records, shredded into columns with levels and rebuilt as related flat tables.

Method. Every leaf path of a type tree becomes a column of (repetition level, definition level, value) triples, as in the Dremel paper (Melnik et al.,
2010): the repetition level tells at which repeated ancestor a new element begins, the definition level how much of the path is there. Records of one tree
share their columns, a repetition level of 0 beginning each. The tables of the repeated and optional ancestors, with the link from each child to its parent,
are then rebuilt from the level sequences alone, a whole column at a time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.drift import child_names, type_trees

COMPOSITE = frozenset(("STRUCT", "LIST", "MAP", "UNION"))


class Node:
    """A node of a type tree with its levels: `rep` and `full` count the repeated ancestors and the definition level of a present, non-null value."""

    __slots__ = ("kind", "step", "children", "rep", "full", "slot", "leaf")

    def __init__(self, kind: str, step: str, rep: int, full: int):
        self.kind, self.step, self.rep, self.full = kind, step, rep, full
        self.children: list[tuple[str, Node]] = []
        self.slot = 0  # definition level at which an element exists, null or not; 0 for a node that isn't repeated
        self.leaf = -1


def plan_tree(tree) -> tuple[Node, list[Node]] | None:
    """The root and its leaves, with levels. A composite node without children is a leaf. None if there is no root or the tree has a cycle."""
    nodes = {}
    for x in tree:
        nodes.setdefault(x["type_id"], x)
    if 0 not in nodes:
        return None
    leaves: list[Node] = []
    used = set()

    def grow(at: int, step: str, rep: int, level: int) -> Node:
        if at in used or at not in nodes:
            raise ValueError("not a tree")
        used.add(at)
        x = nodes[at]
        kind = x["kind"] or ""
        me = Node(kind, step, rep, level + 1)
        subs = list(x["subtypes"]) if kind in COMPOSITE else []
        names = child_names(kind, subs, x["field_names"])
        if kind in ("LIST", "MAP"):
            me.slot = level + 2
        for name, sub in zip(names, subs):
            if kind == "LIST":
                below = grow(sub, "", rep + 1, level + 2)
            elif kind == "MAP":
                below = grow(sub, "." + name, rep + 1, level + 2)
            elif kind == "UNION":
                below = grow(sub, ".value", rep, level + 1)
            else:
                below = grow(sub, "." + name, rep, level + 1)
            me.children.append((name, below))
        if not me.children:
            me.leaf = len(leaves)
            leaves.append(me)
        return me

    try:
        return grow(0, "$", 0, -1), leaves
    except (ValueError, RecursionError):
        return None


def as_typed(value, kind: str):
    """A composite value in the form that its kind asks for, however it was written: as text, or a lone element in place of a list. Else None."""
    if value is None or kind not in COMPOSITE:
        return value
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            inner = value if kind == "LIST" else None
        if inner is None or not isinstance(inner, (dict, list)):
            return [value] if kind == "LIST" and value.strip() != "null" else None
        value = inner
    if kind == "LIST":
        return value if isinstance(value, list) else [value]
    if kind == "MAP":
        if isinstance(value, dict):
            if value.keys() <= {"key", "value"} and value:
                return [value]
            return [{"key": k, "value": v} for k, v in value.items()]
        return value if isinstance(value, list) else None
    if isinstance(value, list) and len(value) == 1 and isinstance(value[0], dict):
        value = value[0]
    return value if isinstance(value, dict) else None


class Columns:
    """The level columns of the records of one tree, and how to write a record into them."""

    def __init__(self, root: Node, leaves: list[Node]):
        self.root, self.leaves = root, leaves
        self.rep: list[list[int]] = [[] for _ in leaves]
        self.level: list[list[int]] = [[] for _ in leaves]
        self.value: list[list] = [[] for _ in leaves]
        self._write = self._writer(root)

    def add(self, record) -> None:
        self._write(record, 0, -1)

    def _blank(self, node: Node) -> Callable[[int, int], None]:
        below = []

        def gather(at: Node) -> None:
            if at.leaf >= 0:
                below.append((self.rep[at.leaf].append, self.level[at.leaf].append, self.value[at.leaf].append))
            for _, child in at.children:
                gather(child)

        gather(node)

        def blank(rep: int, level: int) -> None:
            for r, d, v in below:
                r(rep)
                d(level)
                v(None)

        return blank

    def _writer(self, node: Node) -> Callable[[object, int, int], None]:
        """Writes one occurrence of a node: its value, the repetition level, and what is defined above it. Every node is optional."""
        kind, full, slot, again = node.kind, node.full, node.slot, node.rep + 1
        blank = self._blank(node)
        if node.leaf >= 0:
            r, d, put = self.rep[node.leaf].append, self.level[node.leaf].append, self.value[node.leaf].append

            def leaf(v, rep, level):
                v = as_typed(v, kind)
                r(rep)
                d(level if v is None else full)
                put(v)

            return leaf
        children = [(name, self._writer(child)) for name, child in node.children]
        if kind == "STRUCT":

            def struct(v, rep, level):
                if type(v) is not dict and (v := as_typed(v, kind)) is None:
                    return blank(rep, level)
                for name, write in children:
                    write(v.get(name), rep, full)

            return struct
        if kind == "UNION":
            blanks = [self._blank(child) for _, child in node.children]

            def union(v, rep, level):
                if (v := as_typed(v, kind)) is None:
                    return blank(rep, level)
                tag = v.get("tag")
                tag = tag if isinstance(tag, int) and not isinstance(tag, bool) else -1
                for i, (_, write) in enumerate(children):
                    if i == tag:
                        write(v.get("value"), rep, full)
                    else:
                        blanks[i](rep, full)

            return union
        one = children[0][1]

        def repeated(v, rep, level):
            if type(v) is not list or kind == "MAP":
                v = as_typed(v, kind)
            if v is None:
                return blank(rep, level)
            if not v:
                return blank(rep, full)
            for x in v:
                if kind == "LIST":
                    one(x, rep, slot)
                else:
                    pair = x if type(x) is dict else {}
                    for name, write in children:
                        write(pair.get(name), rep, slot)
                rep = again

        return repeated


def shred(root: Node, leaves: list[Node], value) -> list[list[tuple[int, int, object]]]:
    """For each leaf, its (repetition level, definition level, value) triples for one record."""
    columns = Columns(root, leaves)
    columns.add(value)
    return [list(zip(*x)) for x in zip(columns.rep, columns.level, columns.value)]


class Rebuilt:
    """The rows of the related tables, from level columns alone.

    A leaf's entries at which an occurrence of one of its ancestors begins are those whose repetition level is no deeper than the ancestor; its definition
    level there tells whether the occurrence exists. The place of an element is the number of entries of its level since one of a lower level.
    """

    def __init__(self, root: Node, rep: list, level: list):
        self.root = root
        self.rep = [np.asarray(x, dtype="int32") for x in rep]
        self.level = [np.asarray(x, dtype="int32") for x in level]
        self.record: dict[int, np.ndarray] = {}
        self.places: dict[tuple[int, int], np.ndarray] = {}
        #: (record of each row, parent path of each row, path of each row, table)
        self.rows: list[tuple[np.ndarray, list[str], list[str], str]] = []
        #: (leaf, entries, path of the row that each belongs to, column)
        self.cells: list[tuple[int, np.ndarray, list[str], str]] = []

    def _record(self, leaf: int) -> np.ndarray:
        if leaf not in self.record:
            self.record[leaf] = np.cumsum(self.rep[leaf] == 0) - 1
        return self.record[leaf]

    def _place(self, leaf: int, r: int) -> np.ndarray:
        """For each entry of a leaf, the place of its element in the r-th repeated ancestor."""
        if (leaf, r) not in self.places:
            rep = self.rep[leaf]
            many = np.cumsum(rep == r)
            fresh = np.maximum.accumulate(np.where(rep < r, np.arange(len(rep)), 0))
            self.places[leaf, r] = many - many[fresh]
        return self.places[leaf, r]

    def _paths(self, leaf: int, at: np.ndarray, form: str, depth: int) -> list[str]:
        if not depth:
            return [form % ()] * len(at)
        return [form % x for x in zip(*[self._place(leaf, r)[at].tolist() for r in range(1, depth + 1)])]

    def _emit(self, leaf: int, at: np.ndarray, parent: tuple[str, int], path: tuple[str, int], table: str) -> None:
        if len(at):
            self.rows.append((self._record(leaf)[at], self._paths(leaf, at, *parent), self._paths(leaf, at, *path), table))

    def walk(self, with_cells: bool = False) -> Rebuilt:
        first: dict[int, int] = {}

        def lead(node: Node) -> int:
            if node.leaf < 0:
                each = [lead(c) for _, c in node.children]
            first[id(node)] = node.leaf if node.leaf >= 0 else each[0]
            return first[id(node)]

        def go(node: Node, path: tuple[str, int], parent: tuple[str, int], table: str, owner: str, column: str, element: bool) -> None:
            """path, parent: a format and the number of places in it. owner: the table that the node's values belong to, as `column`."""
            leaf = first[id(node)]
            rep, level = self.rep[leaf], self.level[leaf]
            if node.kind in ("STRUCT", "UNION") and node is not self.root:
                if not element:
                    self._emit(leaf, np.flatnonzero((rep <= node.rep) & (level >= node.full)), parent, path, table)
                parent, owner, column = path, table, ""
            if node.leaf >= 0:
                if with_cells:
                    at = np.flatnonzero(level >= node.full)
                    self.cells.append((leaf, at, self._paths(leaf, at, *parent), column))
                return
            if node.kind in ("STRUCT", "UNION"):
                for name, child in node.children:
                    step = child.step if node.kind == "STRUCT" else f".value<{name}>"
                    go(child, (path[0] + child.step.replace("%", "%%"), path[1]), parent, table + step, owner, (column + step).lstrip("."), False)
                return
            here, inside = (path[0] + "[%d]", path[1] + 1), table + "[]"
            self._emit(leaf, np.flatnonzero((rep <= node.rep + 1) & (level >= node.slot)), parent, here, inside)
            for _, child in node.children:
                go(child, (here[0] + child.step.replace("%", "%%"), here[1]), here, inside + child.step, inside, child.step.lstrip("."), node.kind == "LIST")

        if self.rep and len(self.rep[0]):
            lead(self.root)
            go(self.root, ("$", 0), ("$", 0), "$", "$", "", False)
        return self


def children_of(root: Node, levels: list[list[tuple[int, int]]]) -> list[tuple[str, str]]:
    """(parent path, child path) of every child, from the leaves' (repetition, definition) sequences alone."""
    built = Rebuilt(root, [[r for r, _ in x] for x in levels], [[d for _, d in x] for x in levels]).walk()
    return [link for _, parents, paths, _ in built.rows for link in zip(parents, paths)]


def leaf_names(root: Node) -> list[str]:
    """The path of each leaf, elements as `[]`."""
    names: list[str] = []

    def go(node: Node, path: str) -> None:
        if node.leaf >= 0:
            names.append(path)
        for name, child in node.children:
            inside = path + ("[]" if node.kind in ("LIST", "MAP") else "")
            go(child, inside + (f".value<{name}>" if node.kind == "UNION" else child.step))

    go(root, "$")
    return names


def complete_json(text):
    """The value of a complete JSON text, NaN and control characters allowed, in a one-tuple; None if it is not complete."""
    if text is None:
        return None
    try:
        return (json.loads(text, strict=False),)
    except (ValueError, RecursionError):
        return None


def with_trees(nested_rows: DataFrame, file_types: DataFrame) -> DataFrame:
    """row_id, payload, tree: each row once (the earliest delivery; a null ingested_at counts as the latest) with its file's type tree as JSON.

    The join is on file_id; a file with a third of all rows is split by adaptive skew handling, as nothing after it needs the partitioning.
    """
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    once = nested_rows.where("row_id is not null").groupBy("row_id").agg(F.min_by(F.struct("file_id", "payload"), F.struct(F.coalesce("ingested_at", late), "payload")).alias("it"))
    rows = once.select("row_id", F.col("it.file_id").alias("file_id"), F.col("it.payload").alias("payload"))
    trees = type_trees(file_types).select("file_id", F.to_json("tree").alias("tree"))
    return rows.join(trees, "file_id").select("row_id", "payload", "tree")


def _by_tree(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], Columns]]:
    """Records of one tree within a batch, shredded: (their row_ids, columns)."""
    plans: dict[str, tuple[Node, list[Node]] | None] = {}
    for part in parts:
        groups = defaultdict(lambda: ([], []))
        for row_id, payload, tree in zip(part["row_id"].tolist(), part["payload"], part["tree"]):
            if (got := complete_json(payload)) is not None:
                ids, values = groups[tree]
                ids.append(row_id)
                values.append(got[0])
        for tree, (ids, values) in groups.items():
            if tree not in plans:
                if len(plans) > 4096:
                    plans.clear()
                plans[tree] = plan_tree([{"kind": None, **x} for x in json.loads(tree)])
            if plans[tree] is not None:
                columns = Columns(*plans[tree])
                for value in values:
                    columns.add(value)
                yield ids, columns


LEVELS = "row_id bigint, leaves array<struct<path:string,rep:array<int>,def:array<int>,value:array<string>>>"
LINKS = "row_id bigint, parent_path string, child_path string"
TABLES = "row_id bigint, table string, parent_path string, child_path string, columns map<string,string>"


def _text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _levels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, columns in _by_tree(parts):
        rows = [(i, []) for i in ids]
        for path, rep, level, value in zip(leaf_names(columns.root), columns.rep, columns.level, columns.value):
            cuts = [*np.flatnonzero(np.asarray(rep) == 0).tolist(), len(rep)]
            for (_, leaves), s, e in zip(rows, cuts, cuts[1:]):
                leaves.append({"path": path, "rep": rep[s:e], "def": level[s:e], "value": [_text(v) for v in value[s:e]]})
        yield pd.DataFrame(rows, columns=["row_id", "leaves"])


def shredded(nested_rows: DataFrame, file_types: DataFrame) -> DataFrame:
    """row_id, leaves (for each leaf path its levels and values): one row per readable payload.

    A payload that is null, empty or not complete JSON has no row, nor has one whose file has no type tree. Composite values count in the shape that the
    type asks for; members that the type doesn't name are left out. Work on a row is bounded by its payload.
    """
    return with_trees(nested_rows, file_types).mapInPandas(_levels, LEVELS)


def _links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, columns in _by_tree(parts):
        row_id = np.asarray(ids, dtype="int64")
        rows = Rebuilt(columns.root, columns.rep, columns.level).walk().rows
        if rows:
            parents, paths = [x for r in rows for x in r[1]], [x for r in rows for x in r[2]]
            yield pd.DataFrame({"row_id": row_id[np.concatenate([r[0] for r in rows])], "parent_path": parents, "child_path": paths})


def children(nested_rows: DataFrame, file_types: DataFrame) -> DataFrame:
    """row_id, parent_path, child_path of every child, rebuilt from the levels of its payload, under the terms of `shredded`."""
    return with_trees(nested_rows, file_types).mapInPandas(_links, LINKS)


def _tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, columns in _by_tree(parts):
        built = Rebuilt(columns.root, columns.rep, columns.level).walk(with_cells=True)
        held = {(i, "$"): {} for i in range(len(ids))}
        rows = [(i, "$", None, "$") for i in range(len(ids))]
        for record, parents, paths, table in built.rows:
            record = record.tolist()
            rows += zip(record, [table] * len(record), parents, paths)
            held |= {k: {} for k in zip(record, paths)}
        for leaf, at, owners, column in built.cells:
            value = columns.value[leaf]
            for record, owner, k in zip(built._record(leaf)[at].tolist(), owners, at.tolist()):
                held[record, owner][column] = _text(value[k])
        yield pd.DataFrame([(ids[i], table, parent, path, held[i, path]) for i, table, parent, path in rows], columns=["row_id", "table", "parent_path", "child_path", "columns"])


def flat_tables(nested_rows: DataFrame, file_types: DataFrame) -> DataFrame:
    """The related flat tables: row_id, table, parent_path, child_path, columns, one row for each record (table and child_path `$`, no parent) and child.

    table is the path of a child without its places, as $.a[].value.b; filter on it for one table. columns holds the non-null values of the leaves whose
    nearest child (else the record) the row is, named by the path from it; an element that is itself a leaf has the name "". Terms as for `shredded`.
    """
    return with_trees(nested_rows, file_types).mapInPandas(_tables, TABLES)


def leaf_values(levels: DataFrame) -> DataFrame:
    """The flat table of values: row_id, leaf_path, ordinal, rep, def, value, one row per entry of a leaf column."""
    one = levels.select("row_id", F.explode("leaves").alias("x"))
    zipped = F.posexplode(F.arrays_zip(F.col("x.rep").alias("rep"), F.col("x.def").alias("def"), F.col("x.value").alias("value")))
    flat = one.select("row_id", F.col("x.path").alias("leaf_path"), zipped.alias("ordinal", "e"))
    return flat.select("row_id", "leaf_path", "ordinal", F.col("e.rep").alias("rep"), F.col("e.def").alias("def"), F.col("e.value").alias("value"))
