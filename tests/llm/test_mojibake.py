"""Wrongly decoded text: planted damage is found and undone, clean text is left alone."""

import pytest

from lamella.llm import mojibake
from lamella.tables import table

CLEAN = {
    "fr": "Le boîtier est fixé à l'électrode de sorte que la chambre résiste à 40 °C – même près du dépôt, où la pièce a été remplacée.",
    "de": "Die Kühlrippe wird gemäß der Zeichnung über dem Gehäuse geführt, während der Fühler für höchstens 5 m² genügt.",
    "ru": "Устройство содержит корпус и катушку, причём датчик удерживается при температуре ниже 40 °C и не касается вала.",
    "en": "See ÐORVIK (HÂLDÃN), 8–46, and VELÃO & CÂNIA; the gap is 40 µm – “tight” at 5 kΩ. ∑_{n=1} x² \\frac{a",
}


@pytest.fixture(scope="module")
def corpus():
    return [(1_000 + i * 4 + j, t) for i in range(150) for j, t in enumerate(CLEAN.values())]


def misread(text, written, read):
    out = ""
    for b in text.encode(written, "ignore"):
        try:
            out += bytes([b]).decode(read)
        except UnicodeDecodeError:
            out += chr(b)
    return out


CASES = {
    1: ("fr", lambda t: misread(t, "utf-8", "cp1252")),
    2: ("de", lambda t: misread(t, "utf-8", "mac_roman")),
    3: ("de", lambda t: misread(t, "utf-8", "cp437")),
    4: ("ru", lambda t: misread(t, "utf-8", "cp1251")),
    5: ("fr", lambda t: misread(t, "cp1252", "cp1251")),
    6: ("ru", lambda t: misread(t, "cp1251", "koi8_r")),
    7: ("ru", lambda t: misread(t, "koi8_r", "cp1251")),
    8: ("ru", lambda t: misread(t, "cp1251", "cp1252")),
    9: ("fr", lambda t: misread(misread(t, "utf-8", "cp1252"), "utf-8", "cp1252")),
    10: ("de", lambda t: t[:60] + misread(t[60:], "utf-8", "cp850")),
}


def damaged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as tokens", "'y' as unit", "1 as docs")
    return {r["doc_id"]: r for r in mojibake.damaged(df).collect()}


def test_planted_damage(spark, corpus):
    got = damaged(spark, corpus + [(k, f(CLEAN[lang])) for k, (lang, f) in CASES.items()])
    assert sorted(got) == sorted(CASES)
    for k in (1, 2, 3, 4, 5, 9, 10):
        assert got[k]["restored"] == CLEAN[CASES[k][0]], k
    for k in (6, 7, 8):  # single letters between scripts are too short to tell alone
        words = CLEAN["ru"].split()
        assert sum(a == b for a, b in zip(got[k]["restored"].split(), words)) >= 0.7 * len(words)


def test_frequent_damage(spark, corpus):
    """One channel gives the same garbled words in many documents; they are restored like rare ones."""
    bad = {"de": misread(CLEAN["de"], "cp1252", "cp1251"), "fr": misread(CLEAN["fr"], "cp1252", "mac_roman"), "ru": misread(CLEAN["ru"], "cp1251", "koi8_r")}
    for lang, many in (("de", 12), ("fr", 12), ("ru", 12), ("de", 60)):
        got = damaged(spark, corpus + [(k, bad[lang]) for k in range(many)])
        assert sorted(got) == list(range(many)), lang
        right = sum(a == b for a, b in zip(got[0]["restored"].split(), CLEAN[lang].split()))
        assert right >= (1.0 if lang == "de" else 0.7) * len(CLEAN[lang].split()), (lang, got[0]["restored"])


def test_lost_characters(spark, corpus):
    text = CLEAN["de"].encode("cp1252", "ignore").decode("utf-8", "replace")
    got = damaged(spark, [*corpus, (1, text), (2, "plain � text"), (3, None), (4, ""), (None, "x�")])
    assert sorted(got) == [1, 2] and not got[2]["complete"]
    assert "Gehäuse geführt, während" in got[1]["restored"]


def test_the_tables(spark, data):
    docs = table(spark, data, "documents")
    found = {r["doc_id"]: r for r in mojibake.damaged(docs).collect()}
    decoys = {r["doc_id"] for r in docs.where("text like '%Âmelin – Ôrval%' or text like '%VELÃO & CÂNIA%'").collect()}
    sure = {r["doc_id"] for r in docs.where("text like '%Ã©%' or text like '%â€%' or text like '%Â°%' or text like '%┬░%' or text like '%вЂ“%' or text like '%�%'").collect()}
    assert sure <= set(found) and not (decoys & set(found)) - sure


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert mojibake.damaged(df).count() == 0


def test_lattice_with_a_lost_byte():
    counts = {"présente": 60, "à": 50, "é": 3, "–": 90}
    lattice, scores = mojibake.Lattice(100, {"é": 60, "à": 50, "–": 90}), mojibake.Scores(100, counts)
    assert scores.judge("prÃ©sente", lattice.readings("prÃ©sente"), {})[0][1] == "présente"
    assert "présente" in lattice.viterbi("prÃ�sente", "cp1252")
    assert scores.judge("VELÃO", lattice.readings("VELÃO"), {})[0] is None


def test_tokens_are_those_of_both_engines(spark):
    texts = ["plain", "é", "aé b\x7fü", "x" * 500 + "é" + "y" * 500, "é" * 450 + " ü", "a🙂b\u0085c-ß", "", None]
    rows = mojibake.document_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: set(r["tokens"]) for r in rows if r["tokens"]} == {i: x for i, t in enumerate(texts) if t and (x := {w for w in mojibake.TOKEN.findall(t) if not w.isascii()})}


def test_share_restored(spark, data):
    """Clean documents of the table read in a wrong encoding as a whole: all are found, nearly all come back character for character."""
    data = data.replace("sf0.001", "sf0.01")  # a source model needs more than some dozen clean documents
    docs = table(spark, data, "documents").where("lang in ('fr', 'de', 'ru')")
    dirty = {r["doc_id"] for r in mojibake.damaged_ids(table(spark, data, "documents")).collect()}
    clean = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] not in dirty]
    channels = ("cp1252", "mac_roman", "cp850", "cp1251", "cp437")
    chosen = clean[:: max(1, len(clean) // 20)][:20]
    bad = {10**6 + i: (t, misread(t, "utf-8", channels[i % 5])) for i, (_, t) in enumerate(chosen)}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()] + [(k, b) for k, (_, b) in bad.items()]
    got = {r["doc_id"]: r["restored"] for r in mojibake.damaged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert bad.keys() <= got.keys()
    assert sum(got[k] == t for k, (t, _) in bad.items()) >= 0.95 * len(bad)


def test_repeated_ids_and_an_undamaged_corpus(spark, corpus):
    assert damaged(spark, corpus) == {}
    df = spark.createDataFrame([*corpus, (1, misread(CLEAN["fr"], "utf-8", "cp1252")), (1, CLEAN["de"]), (1, None)], "doc_id bigint, text string")
    assert sorted(r["restored"] for r in mojibake.damaged(df).collect()) == sorted([CLEAN["fr"], CLEAN["de"]])
