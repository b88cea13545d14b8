"""Evaluation texts that leaked into training text, by latent semantic retrieval.

Documents are read into the numbers of those of their words that occur in any item. A randomised SVD of the TF-IDF passages of all documents gives a
latent space: the pairs of words that share passages are counted once, as a sparse table in the shared folder, and each step of the range finder is a
product with that table, made where its parts are; the driver only gets vocabulary times sketch width numbers. Passages are then searched by cosine at two
scales, and what comes near is checked on the words themselves.

Short passages are RUN words long. A case consists of runs that document and item share; a shared run is a short passage of both with the same words,
hence the same latent vector, so its cosine is 1 whatever the space. The search at this scale asks for cosine 1 and therefore loses no case; the check
that follows counts the item's words under the runs found. Long passages are two blocks of words, compared with whole items; they find what is merely
near and serve the report only, since a long item or short separate runs push their cosine below any useful threshold. Longest common subsequence and
the item's telling words tell a paraphrase from what is alike.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import spread, written

WORD = re.compile(r"[^\W_]+")
#: Names whose tags may have attributes without a value; single letters are not among them, as they stand in formulas.
NAMES = "br|hr|img|div|span|table|tbody|thead|tfoot|tr|td|th|ol|ul|li|dl|dt|dd|input|option|select|script|style|link|meta|body|head|html|font|sub|sup|pre|code|col"
#: A tag is a name, then attributes with values, or anything within the line after one of NAMES. Any other "<" is punctuation, as in a<b and c>d.
TAG = re.compile(
    r"</?[A-Za-z][\w:.-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"<]{0,1000}\"|'[^'<]{0,1000}'|[^\s\"'<>=]+(?=[\s>])))*\s*/?>"
    rf"|(?i:</?(?:{NAMES}))\s[^<>\r\n]{{0,300}}>"
    r"|<!--(?:(?!-->|<!--)[\s\S]){0,2000}-->|<![A-Za-z\[][^<>\r\n]{0,300}>"
)
BROKEN = re.compile(r"([^\W_]+)[-‐­][ \t]*\r?\n\s*([^\W_]+)")
LINE_END = re.compile(r"[-‐\u00ad][ \t]*\r?\n")
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")

#: Words in a block; a passage is two blocks, so that any run of up to a block lies within one passage.
BLOCK = 12
#: Dimensions of the latent space, those more in which the randomised range is sought, and steps of power iteration.
LATENT, OVERSAMPLING, POWER = 96, 16, 4
#: Cells up to which a task counts word pairs in an array; beyond, it sorts them. The counts are the same.
DENSE = 1 << 22
#: Weight of the items' own passages in the Gram matrix against all passages of the corpus: without them, words that are rare in the corpus have no axis.
ITEM_WEIGHT = 10.0
#: Cosine from which a long passage is a candidate.
NEAR = 0.4
#: By how much the latent vectors of equal short passages may differ, as a share of their length: they are summed up in different orders.
ROUNDING = 1e-9
#: Consecutive words that make a run, and the share of the item's words that must recur in runs.
RUN, SHARE = 6, 0.5
#: Words of documents, and blocks, that are worked on at once; they bound memory, not results.
SLICE_WORDS, SEGMENTS = 300_000, 8_192
#: Items searched together; their words bound the vocabulary, the range that is sought and what is sent to the executors.
ITEM_BLOCK = 5_000


def words(text: str, known=frozenset()) -> list[str]:
    """The words of a text: runs of letters and digits in lower case, without mark-up; a word cut by a hyphen at a line's end counts as one.

    Where the halves are known words and the whole is not, the hyphen belongs to a compound, and the halves count.
    """
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = TAG.sub(" ", html.unescape(text))
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if LINE_END.search(text):
        split = lambda m: m[1] + " " + m[2] if (m[1] + m[2] not in known and m[1] in known and m[2] in known) else m[1] + m[2]
        text = BROKEN.sub(split, text)
    if not text.isascii() and INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    return WORD.findall(text)


@dataclass
class Items:
    """A block of held-out items as word numbers, and the run hashes of each."""

    ids: list[int]
    vocabulary: dict[str, int]
    sequences: list[np.ndarray]
    runs: list[np.ndarray] = field(default_factory=list)
    lengths: np.ndarray | None = None
    #: Distinct run hashes in order; where the postings of each begin; the item and the word at which each posting stands.
    keys: np.ndarray | None = None
    begins: np.ndarray | None = None
    holder: np.ndarray | None = None
    position: np.ndarray | None = None
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    foreign: float = 0.0
    least: float = 0.0
    #: The latent vector of each word; a random direction's part of it; the short passages of all items by their part in that direction, and their vectors.
    rows: np.ndarray | None = None
    mark: np.ndarray | None = None
    marks: np.ndarray | None = None
    short: np.ndarray | None = None


def run_hashes(runs: np.ndarray) -> np.ndarray:
    """A 64-bit number for every row of consecutive words."""
    out = np.zeros(len(runs), dtype="uint64")
    for j in range(runs.shape[1]):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ ((runs[:, j].astype("uint64") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        out ^= out >> np.uint64(29)
    return out


def runs_of(seq: np.ndarray) -> np.ndarray:
    """All runs of RUN consecutive words, one a row."""
    return np.lib.stride_tricks.sliding_window_view(seq, RUN) if len(seq) >= RUN else np.zeros((0, RUN), dtype=seq.dtype)


def read_items(rows: list[tuple[int, str]]) -> Items:
    """Items without words are left out."""
    vocabulary: dict[str, int] = {}
    ids, sequences = [], []
    for item_id, text in rows:
        seq = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text or "")]
        if item_id is not None and seq:
            ids.append(item_id)
            sequences.append(np.array(seq, dtype="int32"))
    out = Items(ids, vocabulary, sequences, [run_hashes(runs_of(s)) for s in sequences])
    sizes = [len(r) for r in out.runs]
    every = np.concatenate([np.zeros(0, dtype="uint64"), *out.runs])
    order = np.argsort(every, kind="stable")
    out.keys, begins = np.unique(every[order], return_index=True)
    out.begins = np.r_[begins, len(every)].astype("int64")
    out.holder = np.repeat(np.arange(len(sizes)), sizes)[order]
    out.position = np.concatenate([np.zeros(0, dtype="int64"), *[np.arange(n) for n in sizes]])[order]
    out.lengths = np.array([len(x) for x in sequences], dtype="int64")
    return out


def hits(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n_words, at, word: of each whole document, where which words of the vocabulary stand. Documents without any are kept."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.get
        for part in parts:
            n, at, what = [], [], []
            for text in part["text"]:
                these = words(text, vocabulary) if text else []
                found = np.fromiter(map(number, these, repeat(-1)), dtype="int32", count=len(these))
                places = np.flatnonzero(found >= 0)
                n.append(len(found))
                at.append(np.diff(places, prepend=0).astype("int32"))
                what.append(found[places])
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_words": n, "at": at, "word": what})

    rows = spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    return rows.mapInPandas(read, "doc_id bigint, n_words int, at array<int>, word array<int>")


def blocks_of(part: pd.DataFrame, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of each hit, its word, first block of each document, words in each block). Places run through all documents, a free block between them."""
    counts = part["n_words"].to_numpy(dtype="int64")
    blocks = -(-counts // block)
    first = np.concatenate([[0], np.cumsum(blocks + 1)])[:-1]
    sizes = np.fromiter((len(x) for x in part["word"]), dtype="int64", count=len(part))
    if not sizes.sum():
        empty = np.zeros(0, dtype="int64")
        return empty, empty, first, np.zeros(int((blocks + 1).sum()), dtype="int64")
    word = np.concatenate([np.asarray(x, dtype="int64") for x in part["word"]])
    places = np.concatenate([np.cumsum(np.asarray(x, dtype="int64")) for x in part["at"]])
    place = np.repeat(first * block, sizes) + places
    width = np.zeros(int((blocks + 1).sum()), dtype="int64")
    for f, b, c in zip(first, blocks, counts):
        width[f : f + b] = block
        if c % block:
            width[f + b - 1] = c % block
    return place, word, first, width


def slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of documents with about SLICE_WORDS words, or one longer document."""
    for part in parts:
        turn = np.cumsum(part["n_words"].to_numpy(dtype="int64")) // SLICE_WORDS
        for _, rows in part.groupby(turn, sort=False):
            yield rows.reset_index(drop=True)


def distinct(key: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; the input is nearly sorted, where sorting is cheap."""
    key = np.sort(key, kind="stable")
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def block_pairs(place: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The pairs of words (the lower number times size plus the higher) of each block, each word with itself included, one entry for each block."""
    key = distinct(place // BLOCK * size + word)
    b, w = key // size, key % size
    begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, dtype="int64")
    rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.r_[begin, len(b)]))
    out = []
    left = np.arange(len(b))
    for step in range(BLOCK):
        left = left[rank[left] >= step]  # those with a word `step` places before them in their block
        out.append(w[left - step] * size + w[left])
    return np.concatenate(out)


def word_pairs(found: DataFrame, size: int) -> DataFrame:
    """a, b, k: in how many blocks of all documents the words a <= b stand together, once for a = b; and the number of blocks, as a = b = -1."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(size * size, dtype="int64") if size * size <= DENSE else None
        n = 0
        frame = lambda cells, k: pd.DataFrame({"a": cells // size, "b": cells % size, "k": k})
        for part in slices(parts):
            place, word, _, width = blocks_of(part)
            n += int((width > 0).sum())
            pairs = block_pairs(place, word, size)
            if dense is not None:
                dense += np.bincount(pairs, minlength=size * size)
            else:
                yield frame(*np.unique(pairs, return_counts=True))
        if dense is not None:
            yield frame(np.flatnonzero(dense), dense[np.flatnonzero(dense)])
        yield pd.DataFrame({"a": [-1], "b": [-1], "k": [n]})

    return found.mapInPandas(count, "a bigint, b bigint, k bigint").groupBy("a", "b").agg(F.sum("k").alias("k"))


def times(a: np.ndarray, b: np.ndarray, k: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    """Adds G q to `out`, G being the symmetric matrix with the cells (a, b, k), a <= b."""
    off = a != b
    row, column, k = np.r_[a, b[off]], np.r_[b, a[off]], np.r_[k, k[off]]
    order = np.argsort(row, kind="stable")
    for s in range(0, len(order), SEGMENTS):
        at = order[s : s + SEGMENTS]
        new = np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])
        out[row[at][new]] += np.add.reduceat(q[column[at]] * k[at][:, None], new, axis=0)


def product(pairs: DataFrame, q: np.ndarray) -> np.ndarray:
    """G q for the table of `word_pairs`. A task sends its sum, the sums are combined before and after a shuffle, and the driver gets one of q's size."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(q.shape)
        for part in parts:
            times(*(part[c].to_numpy() for c in ("a", "b", "k")), q, total)
        there = np.flatnonzero(total.any(axis=1))
        if len(there):
            yield pd.DataFrame({"word": there, "row": list(total[there])})

    sums = pairs.where("a >= 0").mapInPandas(multiply, "word bigint, row array<double>")
    out = np.zeros(q.shape)
    for r in sums.groupBy("word").agg(Summarizer.sum(array_to_vector(F.col("row"))).alias("row")).toLocalIterator():
        out[r["word"]] = r["row"].toArray()
    return out


def latent_space(g: Callable[[np.ndarray], np.ndarray], size: int, dimensions: int = LATENT, seed: int = 11) -> np.ndarray:
    """The strongest right singular vectors of A by a randomised range finder with power iteration (Halko, Martinsson, Tropp, 2011); g multiplies by AᵀA."""
    q = np.random.default_rng(seed).standard_normal((size, min(size, dimensions + OVERSAMPLING)))
    for _ in range(1 + POWER):
        q = np.linalg.qr(g(q))[0]
    core = q.T @ g(q)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:dimensions]]


def least_mass(items: Items) -> float:
    """A TF-IDF mass that every case reaches in some passage: with only lighter runs than this, no item has half of its words covered."""
    out = np.inf
    for seq, runs in zip(items.sequences, items.runs):
        if not len(runs):
            continue
        mass = np.array([(items.idf[np.unique(seq[i : i + RUN])] ** 2).sum() for i in range(len(runs))])
        mark = np.zeros(len(seq), dtype=bool)
        for i in np.argsort(mass):
            mark[i : i + RUN] = True
            if mark.sum() >= SHARE * len(seq):
                out = min(out, float(mass[i]))
                break
    return out


def fit(items: Items, found: DataFrame) -> Items:
    """The latent space of all documents, and the items in it."""
    size = len(items.vocabulary)
    pairs = written(word_pairs(found, size), "word-pairs")
    own = np.concatenate([block_pairs(np.arange(len(s)), s.astype("int64"), size) for s in items.sequences])
    own, own_k = np.unique(own, return_counts=True)
    held = np.zeros(size)
    n = 0
    for r in pairs.where("a = b").toLocalIterator():
        if r["a"] < 0:
            n = r["k"]
        else:
            held[r["a"]] = r["k"]
    items.idf = np.log((n + 1.0) / (held + 1.0))
    d = items.idf[:, None]
    same = own // size == own % size
    mass = max(1e-9, float((held * items.idf**2).sum()))
    own_mass = max(1e-9, float((own_k[same] * items.idf[own[same] % size] ** 2).sum()))

    def g(q: np.ndarray) -> np.ndarray:
        theirs = np.zeros(q.shape)
        times(own // size, own % size, own_k, d * q, theirs)
        return d * product(pairs, d * q) / mass + ITEM_WEIGHT * d * theirs / own_mass

    basis = latent_space(g, size)
    items.basis = basis.astype("float32")
    z = np.stack([np.minimum(np.bincount(s, minlength=size), 2) * items.idf for s in items.sequences]).astype("float32") @ items.basis
    items.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    items.foreign = float(np.log(n + 1.0)) ** 2
    items.least = least_mass(items)
    items.rows = basis * items.idf[:, None]
    items.mark = items.rows @ np.random.default_rng(5).standard_normal(items.rows.shape[1])
    at = np.concatenate([np.zeros((0, RUN), dtype="int64"), *map(runs_of, items.sequences)])
    at = np.unique(np.sort(at, axis=1), axis=0)  # of passages with the same words one will do
    marks = items.mark[at].sum(axis=1)
    order = np.argsort(marks)
    items.marks, items.short = marks[order], at[order]
    return items


def short_candidates(word: np.ndarray, run: np.ndarray, items: Items) -> np.ndarray:
    """Which of the short passages that begin at `run` have cosine 1 with a short passage of an item.

    Equal vectors have equal parts in any direction, so item passages are looked up by their part in one; those found are compared as a whole.
    """
    if not len(items.marks) or not len(run):
        return run[:0]
    mark = items.mark[word]
    parts = mark[run].copy()
    for j in range(1, RUN):
        parts += mark[run + j]
    slack = ROUNDING * max(1.0, float(np.abs(items.mark).max()))
    lo, hi = np.searchsorted(items.marks, parts - slack), np.searchsorted(items.marks, parts + slack)
    some = np.flatnonzero(hi > lo)
    hit = np.zeros(len(run), dtype=bool)
    for s in range(0, len(some), SEGMENTS):
        at = some[s : s + SEGMENTS]
        many = hi[at] - lo[at]
        own = np.repeat(at, many)
        theirs = np.repeat(lo[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        a = items.rows[word[run[own][:, None] + np.arange(RUN)]].sum(axis=1)
        b = items.rows[items.short[theirs]].sum(axis=1)
        # cosine 1, stated by the distance as it also holds for vectors of length 0
        near = np.linalg.norm(a - b, axis=1) <= 1e-6 * np.linalg.norm(b, axis=1) + 1e-9
        hit[own[near]] = True
    return run[hit]


def candidates(part: pd.DataFrame, items: Items, near: float) -> list[tuple[int, int, float, int]]:
    """(row, item, cosine, first word of the best passage) of every document and item with a passage as near as `near`."""
    place, word, first, width = blocks_of(part)
    if len(place) < RUN:
        return []
    where = place // BLOCK
    size = len(items.idf)
    n = len(width)
    key = distinct(where * size + word)
    b, w = key // size, key % size
    begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    weight = np.zeros(n + 1)
    weight[b[begin]] = np.add.reduceat(items.idf[w] ** 2, begin)
    held = np.r_[np.bincount(where, minlength=n), 0]
    mass, both = weight[:-1] + weight[1:], held[:-1] + held[1:]
    # a run lies in a passage, so no case is among passages with fewer hits or less mass
    there = (both >= RUN) & (mass >= items.least * (1 - 1e-9))
    there = np.flatnonzero(there)
    if not len(there):
        return []
    need = np.zeros(n + 1, dtype=bool)
    need[there] = need[there + 1] = True
    kept = need[b]
    b, w = b[kept], w[kept]
    begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    slot = np.full(n + 1, len(begin))
    slot[b[begin]] = np.arange(len(begin))
    z = np.zeros((len(begin) + 1, items.basis.shape[1]), dtype="float32")
    rows = items.basis * items.idf[:, None].astype("float32")
    for s in range(0, len(begin), SEGMENTS):
        e = min(s + SEGMENTS, len(begin))
        z[s:e] = np.add.reduceat(rows[w[begin[s] : begin[e] if e < len(begin) else len(w)]], begin[s:e] - begin[s], axis=0)
    lost = (width + np.r_[width[1:], 0] - both) * items.foreign * 0.25
    out: dict[tuple[int, int], tuple[float, int]] = {}
    for s in range(0, len(there), 8192):
        at = there[s : s + 8192]
        cos = ((z[slot[at]] + z[slot[at + 1]]) @ items.latent.T) / np.sqrt(mass[at] + lost[at] + 1e-9)[:, None]
        for i, j in zip(*np.nonzero(cos >= near)):
            row = int(np.searchsorted(first, at[i], side="right") - 1)
            value = (float(cos[i, j]), int(at[i] - first[row]) * BLOCK)
            if (row, int(j)) not in out or out[row, int(j)] < value:
                out[row, int(j)] = value
    return [(r, j, c, p) for (r, j), (c, p) in out.items()]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of `a` (Hyyrö, 2004)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def coverage(part: pd.DataFrame, items: Items) -> pd.DataFrame:
    """row, item, coverage, at of every document and item that share a run: the share of the item's words under shared runs, and where the first one begins.

    The runs are the short passages that the latent search gives, checked word for word.
    """
    place, word, first, _ = blocks_of(part)
    none = pd.DataFrame({"row": [], "item": [], "coverage": [], "at": []}).astype({"row": "int64", "item": "int64", "at": "int64"})
    if len(place) < RUN or not len(items.keys):
        return none
    run = np.flatnonzero(place[RUN - 1 :] - place[: len(place) - RUN + 1] == RUN - 1)
    run = short_candidates(word, run, items)
    if not len(run):
        return none
    hashes = run_hashes(word[run[:, None] + np.arange(RUN)])
    slot = np.minimum(np.searchsorted(items.keys, hashes), len(items.keys) - 1)
    hit = items.keys[slot] == hashes
    run, slot = place[run[hit]], slot[hit]
    if not len(run):
        return none
    row = np.searchsorted(first, run // BLOCK, side="right") - 1
    _, one = np.unique(row * len(items.keys) + slot, return_index=True)  # the first place of each run in each document
    row, slot, at = row[one], slot[one], (run - first[row] * BLOCK)[one]
    many = items.begins[slot + 1] - items.begins[slot]
    each = np.repeat(items.begins[slot] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    row, at, item, position = np.repeat(row, many), np.repeat(at, many), items.holder[each], items.position[each]
    order = np.lexsort((position, item, row))
    row, at, item, position = row[order], at[order], item[order], position[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    adds = np.minimum(np.r_[position[1:] - position[:-1], RUN], RUN)
    adds[np.r_[new[1:], True]] = RUN
    begin = np.flatnonzero(new)
    words_under = np.add.reduceat(adds, begin)
    return pd.DataFrame({"row": row[begin], "item": item[begin], "coverage": words_under / items.lengths[item[begin]], "at": np.minimum.reduceat(at, begin)})


MATCHES = "item_id bigint, doc_id bigint, cosine double, subsequence double, telling double, coverage double, verdict string"


def _cases(items: Items):
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.array(items.ids, dtype="int64")
        for part in slices(parts):
            seen = coverage(part, items)
            seen = seen[seen["coverage"] >= SHARE]
            yield pd.DataFrame({"item_id": ids[seen["item"]], "doc_id": part["doc_id"].to_numpy()[seen["row"]]})

    return find


def _search(items: Items, near: float):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            rows = []
            shares, begins = {}, {}
            for r, j, share, at in coverage(part, items).itertuples(index=False):
                shares[r, j], begins[r, j] = share, at
            near_by: dict[int, list] = {}
            close = {(r, j): (c, p) for r, j, c, p in candidates(part, items, near)}
            for r, j in close.keys() | {k for k, share in shares.items() if share >= SHARE}:
                near_by.setdefault(r, []).append((j, *close.get((r, j), (None, begins.get((r, j), 0)))))
            for r, list_ in near_by.items():
                seq = np.full(int(part["n_words"][r]), -1, dtype="int64")
                seq[np.cumsum(np.asarray(part["at"][r], dtype="int64"))] = part["word"][r]
                for j, c, p in list_:
                    item = items.sequences[j]
                    around = seq[max(0, p - 2 * len(item)) : p + 2 * BLOCK + 2 * len(item)]
                    around = around[around >= 0]
                    length = common_subsequence(item, around)
                    share = shares.get((r, j), 0.0)
                    if length < RUN and share < SHARE:
                        continue
                    top = np.unique(item)
                    top = top[np.argsort(-items.idf[top])][: max(3, len(top) // 4)]
                    telling = float(np.isin(top, around).mean())
                    subsequence = length / len(item)
                    verdict = "verbatim" if share >= 0.9 else "partial" if share >= SHARE else "paraphrase" if subsequence >= 0.5 and telling >= 0.6 else "alike"
                    rows.append((items.ids[j], int(part["doc_id"][r]), c, subsequence, telling, share, verdict))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "cosine", "subsequence", "telling", "coverage", "verdict"]).astype({"cosine": "float64"})

    return search


def _by_blocks(documents: DataFrame, eval_items: DataFrame, item_block: int, searched: Callable[[Items], DataFrame], schema: str) -> DataFrame:
    """What `searched` finds for the items, taken in blocks, each against all documents."""
    rows = eval_items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id")
    out = None
    block: list[tuple[int, str]] = []

    def add(block: list[tuple[int, str]]) -> DataFrame:
        items = read_items(block)
        new = searched(items) if items.ids else documents.sparkSession.createDataFrame([], schema)
        return new if out is None else out.unionByName(new)

    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == item_block:
            out, block = add(block), []
    return add(block) if block or out is None else out


def matches(documents: DataFrame, eval_items: DataFrame, near: float = NEAR, item_block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, doc_id, cosine, subsequence (LCS over the item's length), telling (share of its rarest words), coverage, verdict.

    verdict: verbatim, partial, paraphrase or merely alike. Verbatim and partial are complete whatever the cosine, which is null where no passage came as
    near as `near`; the others are those that came near. All documents are read whole. The items, a held-out set that doesn't grow with the corpus, are
    taken in blocks, each against all documents. Null and empty texts match nothing; repeated item_ids count as one, with the greatest text.
    """

    def searched(items: Items) -> DataFrame:
        found = written(hits(documents, items.vocabulary), "leak-hits")
        return found.mapInPandas(_search(fit(items, found), near), MATCHES)

    return _by_blocks(documents, eval_items, item_block, searched, MATCHES)


def leaked(documents: DataFrame, eval_items: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, doc_id of the pairs in which at least half of the item's words recur in runs of six or more.

    Complete: short passages are searched at cosine 1, which every shared run has (see above), and then checked. Otherwise as `matches`.
    """
    schema = "item_id bigint, doc_id bigint"

    def searched(items: Items) -> DataFrame:
        found = written(hits(documents, items.vocabulary), "leak-hits")
        return found.mapInPandas(_cases(fit(items, found)), schema)

    return _by_blocks(documents, eval_items, item_block, searched, schema)
