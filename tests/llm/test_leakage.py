"""Leaks against brute force, planted ones among them."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import leakage
from lamella.tables import table


def plain_words(text):
    text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text).replace("&ldquo;", "“").replace("&lt;", "<").replace("&gt;", ">")
    return re.findall(r"[^\W_]+", re.sub(r"-\s*\n\s*", "", text).lower())


def brute(docs, items):
    out = set()
    for item_id, text in items:
        w = plain_words(text or "")
        runs = {}
        for i in range(len(w) - 5):
            runs.setdefault(tuple(w[i : i + 6]), []).append(i)
        for doc_id, doc in docs:
            d, hit = plain_words(doc or ""), set()
            for k in range(len(d) - 5):
                for i in runs.get(tuple(d[k : k + 6]), ()):
                    hit.update(range(i, i + 6))
            if w and len(hit) >= len(w) / 2:
                out.add((item_id, doc_id))
    return out


@pytest.fixture(scope="module")
def items(spark, data):
    return [(r["item_id"], r["text"]) for r in table(spark, data, "eval_items").collect()]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as at", "'y' as word", "1 as n_words")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' as doc_id")
    return sorted((r["item_id"], r["doc_id"]) for r in leakage.leaked(d, i).collect())


def test_against_brute_force(spark, data, items):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    expected = brute(docs, items)
    assert found(spark, docs, items) == sorted(expected)


def test_planted(spark, data, items):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()][:40]
    text = dict(items)
    w = {i: text[i].split() for i in text}
    half = lambda i: " ".join(w[i][: len(w[i]) * 6 // 10])
    base = [t for _, t in docs]
    planted = [
        (1, base[0][:800] + "\n<p>" + text[1] + "</p>\n" + base[0][800:]),
        (2, base[1][:500] + " " + half(2).upper() + " " + base[1][500:]),
        (3, base[2] + "\n" + text[3].replace(" ", " \n", 30)),
        (4, base[3] + " " + " and then ".join(" ".join(w[4][i : i + 14]) for i in range(0, len(w[4]), 14))),
        (5, base[4] + " " + " ".join(" ".join(w[5][i : i + 4]) + " also" for i in range(0, len(w[5]), 4))),
        (6, None),
        (7, ""),
        (8, text[8]),
        (8, text[8]),
        (9, "word " * 60_000 + text[9] + " word" * 60_000),
    ]
    got = found(spark, planted + docs[10:], items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (8, 8), (9, 9)} <= set(got) and got.count((8, 8)) == 2
    assert not {d for i, d in got if d in (5, 6, 7)}


def test_long_items_and_separate_runs(spark):
    """Pairs whose passages lie far from the item as a whole: a long item, and half of one in short runs among other words."""
    rng = np.random.default_rng(5)
    item = {i: [f"w{k}" for k in rng.integers(0, 4_000, n)] for i, n in ((1, 400), (2, 60), (3, 150), (4, 60))}
    other = lambda n: [f"w{k}" for k in rng.integers(0, 4_000, n)]
    split = lambda w, run, share: [x for i in range(0, len(w), round(run / share)) for x in w[i : i + run] + other(25)]
    docs = [(10 + k, " ".join(other(800))) for k in range(40)]
    docs += [(1, " ".join(other(300) + item[1] + other(300))), (2, " ".join(other(50) + split(item[2], 6, 0.5))), (3, " ".join(split(item[3], 8, 0.5))), (4, " ".join(split(item[4], 5, 0.8)))]
    texts = [(i, " ".join(w)) for i, w in item.items()]
    assert found(spark, docs, texts) == sorted(brute(docs, texts)) == [(1, 1), (2, 2), (3, 3)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(texts, "item_id bigint, text string")
    report = {(r["item_id"], r["doc_id"]): r["verdict"] for r in leakage.matches(d, i).collect()}
    assert report[1, 1] == "verbatim" and report[2, 2] == report[3, 3] == "partial"


def test_edges(spark, items):
    assert found(spark, [(1, "a b c")], [(1, None), (2, "")]) == []
    assert found(spark, [], items[:3]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(None, items[0][1])], items[:3]) == []
    report = leakage.matches(spark.createDataFrame([(5, items[0][1])], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), item_block=50)
    top = [r for r in report.collect() if r["item_id"] == items[0][0]]
    assert len(top) == 1 and top[0]["verdict"] == "verbatim" and top[0]["subsequence"] == 1.0


def test_words():
    assert leakage.words("Half-\nopen <b>Door</b>, 3.5&nbsp;mm² co­operate_x") == ["halfopen", "door", "3", "5", "mm²", "cooperate", "x"]
    assert leakage.words("half-\nempty com-\npressor", {"half", "empty", "com", "compressor"}) == ["half", "empty", "compressor"]


def test_less_than_is_no_markup():
    assert leakage.words("if a<b then all of\nthis stays c>d") == "if a b then all of this stays c d".split()
    assert leakage.words("if a&lt;b and this stays c&gt;d, x <y, z> 0") == "if a b and this stays c d x y z 0".split()
    assert leakage.words('<p class="x > y">in <img id=\'m0\'/> <td nowrap>and</td><br/></p> <o:p>on<a href=x.html> <!-- not\nthis --> <!DOCTYPE html>') == ["in", "and", "on"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(-1, 5), max_size=40))
def test_common_subsequence(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    assert leakage.common_subsequence(np.array(a, dtype="int64"), np.array(b, dtype="int64")) == best[-1]


@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_word_pairs_are_exact(spark, monkeypatch, dense):
    monkeypatch.setattr(leakage, "DENSE", dense)
    docs = spark.createDataFrame([(1, "a b c a " * 9), (2, "b z c"), (3, None)], "doc_id bigint, text string")
    pairs = leakage.word_pairs(leakage.hits(docs, {"a": 0, "b": 1, "c": 2}), 3)
    assert {(r["a"], r["b"]): r["k"] for r in pairs.collect()} == {(-1, -1): 4, (0, 0): 3, (0, 1): 3, (0, 2): 3, (1, 1): 4, (1, 2): 4, (2, 2): 4}
    q = np.arange(6.0).reshape(3, 2)
    assert np.allclose(leakage.product(pairs, q), np.array([[3, 3, 3], [3, 4, 4], [3, 4, 4]]) @ q)


def test_latent_space_is_that_of_the_gram_matrix():
    """Passages on eight topics, and passages without any structure: the strongest directions lie in the space."""
    rng = np.random.default_rng(3)
    topics = rng.random((8, 60)) ** 6
    for rates, strongest in ((topics[rng.integers(0, 8, 4_000)] * 0.5, 8), (np.tile(rng.random(60) * 0.2, (4_000, 1)), 10)):
        a = (rng.random((4_000, 60)) < rates).astype(float)
        basis = leakage.latent_space(lambda q: a.T @ (a @ q), 60, 20)
        assert np.linalg.norm(basis.T @ np.linalg.eigh(a.T @ a)[1][:, -strongest:], axis=0).min() > 0.99


def test_recall_of_interrupted_runs(spark):
    """Every case by the definition: items in runs of 6 to 14 words with gaps of 0 to 30 other words of the same vocabulary between them."""
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 3_000]
    items = {i: word(n) for i, n in enumerate(rng.integers(12, 200, 60))}
    docs = []
    for k, (run, gap, share) in enumerate((r, g, q) for r in (6, 8, 12, 14) for g in (0, 3, 6, 10, 18, 30) for q in (0.4, 0.5, 0.7, 1.0)):
        w, text = items[k % 60], word(40)
        for i in range(0, int(len(w) * share), run):
            text += [*w[i : i + run], *word(gap)]
        docs.append((k, " ".join(text + word(40))))
    texts = [(i, " ".join(w)) for i, w in items.items()]
    expected = brute(docs, texts)
    assert len(expected) > 50 and found(spark, docs, texts) == sorted(expected)
