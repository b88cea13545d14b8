"""Text that was decoded with another encoding than it was written in: found, and restored where possible.

Method: noisy-channel decoding. The channel takes a text, writes it in one encoding and reads it in another. Frequencies of words and characters over all
documents are the source model. A damaged token is turned back into a lattice of bytes, with a wildcard for each lost byte; a Viterbi search finds the
likeliest characters behind it, and the word frequencies choose between the channels and the token as it stands.

Texts are read once. Everything after that works on their distinct tokens beyond ASCII: a token's readings are scored once in the whole cluster, where
they are joined with the frequencies of just the units that occur in them, and a document is judged by what its own tokens are joined with. Only the
character frequencies are broadcast, which the size of Unicode bounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import spread, written

#: Encodings that texts are misread in, and single-byte encodings that they were written in: fixed values.
MISREAD = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1250", "iso8859_5")
WRITTEN = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_5")

#: A token is a run of letters and characters beyond ASCII, in pieces of PIECE where it is longer, so that work on a token is bounded.
PIECE = 200
TOKEN = re.compile(rf"[A-Za-z\u0080-\U0010ffff]{{1,{PIECE}}}")
BETWEEN = r"[\x00-@\[-`{-\x7f]+"
WORD = re.compile(r"[^\W\d_]+")
LOST = "�"

#: A unit belongs to the model if it stands in two tokens of documents, whatever the size of the corpus.
LEAST = 2
#: What a unit outside the model counts as, in documents.
UNSEEN = 0.3
#: Log-odds: of a token by its lattice; summed over a document's distinct tokens for a single-byte channel.
TOKEN_GAIN, CHANNEL_GAIN = 1.0, 5.0
BEAM = 6
#: How many times as frequent as the next a word must be to stand in for lost characters.
CLEAR = 3
#: How many misreadings one upon another are undone.
DEPTH = 3


def token_units(token: str) -> set[str]:
    low = token.lower()
    out = {w for w in WORD.findall(low) if not w.isascii()}
    out.update(c for c in low if c > "\x7f" and not c.isalpha())
    return out


class Channels:
    """The tables of every misreading."""

    def __init__(self):
        self.byte: dict[str, dict[str, int]] = {}
        for w in MISREAD:
            table = {}
            for b in range(128, 256):
                try:
                    table[bytes([b]).decode(w)] = b
                except UnicodeDecodeError:
                    table[chr(b)] = b
            for b in range(128, 160):
                table.setdefault(chr(b), b)
            self.byte[w] = table
        self.single: dict[tuple[str, str], dict[int, str]] = {}
        for w in MISREAD:
            for r in WRITTEN:
                if w == r:
                    continue
                table = {}
                for c, b in self.byte[w].items():
                    try:
                        table[ord(c)] = bytes([b]).decode(r)
                    except UnicodeDecodeError:
                        pass
                self.single[w, r] = {k: v for k, v in table.items() if chr(k) != v}
        #: A lead byte and a continuation byte of UTF-8, or a lost byte, in each misreading: without one there is nothing to decode.
        self.suspicious: dict[str, re.Pattern] = {}
        for w in MISREAD:
            lead = "".join(re.escape(c) for c, b in self.byte[w].items() if 0xC2 <= b <= 0xF4)
            follow = "".join(re.escape(c) for c, b in self.byte[w].items() if 0x80 <= b <= 0xBF)
            self.suspicious[w] = re.compile(f"[{lead}][{follow}{LOST}]")


def skeleton(word: str) -> str:
    return re.sub(r"[^\x00-\x7f]", LOST, word)


#: The parts of a token around lost characters.
GAPS = re.compile(rf"[^\W\d_{LOST}]*(?:{LOST}[^\W\d_{LOST}]*)+")


class Lattice:
    """Channels and character frequencies: what may stand behind a token."""

    def __init__(self, docs: int, letters: dict[str, int]):
        self.n, self.letters = max(1, docs), letters
        self.channels = Channels()
        self.floor = math.log(UNSEEN / self.n)
        self.patterns: dict[tuple, list[str]] = {}
        self.encoded = [(c, c.encode("utf-8")) for c in [*letters, *{c.upper() for c in letters if len(c.upper()) == 1}]]

    def char_log(self, c: str) -> float:
        if c < "\x80":
            return 0.0
        k = self.letters.get(c.lower(), 0)
        return math.log(k / self.n) if k else self.floor

    def matching(self, pattern: tuple) -> list[str]:
        """Characters of the corpus whose UTF-8 form fits a byte pattern with None for lost bytes."""
        if pattern not in self.patterns:
            self.patterns[pattern] = [c for c, b in self.encoded if len(b) == len(pattern) and all(p is None or p == x for p, x in zip(pattern, b))]
        return self.patterns[pattern]

    def viterbi(self, token: str, misread: str) -> list[str]:
        """The likeliest texts behind a token that was written in UTF-8 and misread, best first; characters may also stand for themselves."""
        table = self.channels.byte[misread]
        lattice = [None if c == LOST else table.get(c, -1) if c > "\x7f" else -1 for c in token]
        best: list[list[tuple[float, str]]] = [[] for _ in range(len(token) + 1)]
        best[0] = [(0.0, "")]
        for i, c in enumerate(token):
            if not best[i]:
                continue
            best[i].sort(key=lambda x: -x[0])
            del best[i][BEAM:]
            keep = 0.0 if c < "\x80" else self.char_log(c) - 1.0
            arcs = [(keep, c, 1)]
            for size in (2, 3, 4):
                pattern = tuple(lattice[i : i + size])
                if len(pattern) < size or -1 in pattern or pattern[0] is None or (size > 2 and all(p is None for p in pattern[1:])):
                    continue
                if None in pattern:
                    arcs += [(self.char_log(x), x, size) for x in self.matching(pattern)]
                else:
                    try:
                        x = bytes(pattern).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(x) == 1:
                        arcs.append((self.char_log(x), x, size))
            for cost, x, size in arcs:
                best[i + size] += [(s + cost, t + x) for s, t in best[i]]
        return [t for _, t in sorted(best[-1], key=lambda x: -x[0])[:BEAM] if t != token]

    def readings(self, token: str) -> list[tuple[str, str, float]]:
        """(channel, text, price) of everything that may stand behind a token, but for words lost in part."""
        out: dict[tuple[str, str], float] = {}
        todo, seen = [(token, None, 0)], {token}
        while todo:
            at, first, depth = todo.pop(0)
            for w in MISREAD if depth < DEPTH else ():
                for text in self.viterbi(at, w) if self.channels.suspicious[w].search(at) else ():
                    channel = first or f"{w}>utf-8"
                    out.setdefault((channel, text), 0.5 * depth)  # the middle form need not be likelier than the token
                    if text not in seen and not text.isascii():
                        seen.add(text)
                        todo.append((text, channel, depth + 1))
        for (w, r), table in self.channels.single.items():
            text = token.translate(table)
            if text != token:
                out[f"{w}>{r}", text] = 0.5
        return [(c, t, p) for (c, t), p in out.items()]


class Scores:
    """The word frequencies that the readings of a token are held against."""

    def __init__(self, docs: int, counts: dict[str, int]):
        self.n, self.counts = max(1, docs), counts
        self.floor = math.log(UNSEEN / self.n)

    def score(self, token: str) -> float:
        """Log-likelihood of a token: its words and other characters; a word of mixed scripts, and a control character, counts as unseen twice."""
        total = 0.0
        for u in token_units(token):
            k = self.counts.get(u, 0)
            total += math.log(k / self.n) if k else self.floor
            if u.isalpha() and len(u) > 1:
                cyrillic = sum("Ѐ" <= c <= "ӿ" for c in u)
                if 0 < cyrillic < len(u):
                    total += self.floor / 2
            elif "\x80" <= u <= "\x9f" or u == LOST:
                total += self.floor / 2
        return total

    def fill(self, token: str, words: dict[str, list[str]]) -> str | None:
        """A token with lost characters, filled in from `words`, the most frequent words behind each of its parts."""
        out = token
        for m in GAPS.finditer(token):
            fits = words.get(m[0].lower(), [])
            # a lone character, or one of two words nearly as frequent, can't be told: it stays lost
            if len(m[0]) < 2 or not fits or (len(fits) > 1 and self.counts[fits[0]] < CLEAR * self.counts[fits[1]]):
                continue
            w = fits[0]
            word = w.upper() if m[0].replace(LOST, "").isupper() and len(w) > 2 else w.capitalize() if m[0][0].isupper() else w
            out = out.replace(m[0], word)
        return out if out != token else None

    def judge(self, token: str, readings: list[tuple[str, str, float]], words: dict[str, list[str]]):
        """(best, others): (channel, text, gain, weight in the document) of the likeliest reading, if it is likelier than the token itself, and
        (channel, text, gain) of the best text of each channel that is."""
        now, best, others = self.score(token), None, {}
        if LOST in token and (filled := self.fill(token, words)):
            readings = [*readings, ("utf-8>lost", filled, 0.0)]
        score: dict[str, float] = {}
        for channel, text, price in readings:
            if text not in score:
                score[text] = self.score(text) - now
                # of channels that agree on a text, the first stands for it
                if score[text] - price >= TOKEN_GAIN and (best is None or score[text] - price > best[2]):
                    best = (channel, text, score[text] - price)
            if score[text] >= TOKEN_GAIN and (channel not in others or score[text] > others[channel][1]):
                others[channel] = (text, score[text])
        return best and (*best, self.weight(token, *best)), [(c, *x) for c, x in others.items()]

    @staticmethod
    def weight(token: str, channel: str, text: str, gain: float) -> float:
        before, after = token_units(token), token_units(text)
        letters = max((len(u) for u in after if u.isalpha()), default=0)
        if channel.endswith(">utf-8"):
            lone = any(len(u) == 1 and "Ѐ" <= u <= "ӿ" for u in after) and letters < 2
            return 0.2 if lone else 5.0
        if channel.endswith(">lost"):
            return 1.0
        mixed = any(u.isalpha() and 0 < sum("Ѐ" <= c <= "ӿ" for c in u) < len(u) for u in before)
        return 1.0 if letters >= 3 or mixed else 0.0


def replaced(text: str, tokens: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: tokens.get(m[0], m[0]), text)


def document_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, tokens: the distinct tokens beyond ASCII of each document that has any. The texts are read here and nowhere else."""
    beyond = lambda c: F.filter(c, lambda x: F.length(x) != F.octet_length(x))
    cut = f"if(length(t) <= {PIECE}, array(t), transform(sequence(1, length(t), {PIECE}), i -> substring(t, i, {PIECE})))"
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", beyond(F.split("text", BETWEEN)).alias("t")).select(
        "doc_id", F.array_distinct(beyond(F.expr(f"flatten(transform(t, t -> {cut}))"))).alias("tokens")
    )


def unit_counts(tokens: DataFrame) -> DataFrame:
    """tokens(token, docs) to unit, docs: in how many tokens of documents each unit stands, if in LEAST or more."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"unit": part["token"].map(token_units).map(sorted), "docs": part["docs"]}).explode("unit").dropna()

    units = tokens.select("token", "docs").mapInPandas(split, "unit string, docs bigint")
    return units.groupBy("unit").agg(F.sum("docs").alias("docs")).where(f"docs >= {LEAST}")


def letter_counts(counts: DataFrame) -> dict[str, int]:
    """For each character beyond ASCII, how frequent the most frequent word with it is. Unicode bounds what is collected."""
    each = counts.select(F.explode(F.split("unit", "")).alias("c"), "docs").where(F.col("c") > "\x7f").where(F.col("c") != LOST)
    return {r["c"]: r["docs"] for r in each.groupBy("c").agg(F.max("docs").alias("docs")).collect()}


READINGS = "token string, readings array<struct<channel:string,text:string,price:double>>, units array<string>, gaps array<string>"


def candidates(tokens: DataFrame, docs: int, letters: dict[str, int]) -> DataFrame:
    """token, its readings, the units of the token and of all readings, and its parts with lost characters."""
    shared = tokens.sparkSession.sparkContext.broadcast((docs, letters))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*shared.value)
        for part in parts:
            rows = []
            for token in part["token"]:
                found = lattice.readings(token)
                units = token_units(token).union(*[token_units(t) for t in {t for _, t, _ in found}])
                rows.append((token, found, sorted(units), sorted({m[0].lower() for m in GAPS.finditer(token)})))
            yield pd.DataFrame(rows, columns=["token", "readings", "units", "gaps"])

    # a token costs a millisecond, so even a small table is spread over all cores
    spread = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.select("token").repartition(spread, "token").mapInPandas(read, READINGS)


def lost_words(of: DataFrame, counts: DataFrame) -> DataFrame:
    """gap, words: the two most frequent words, with their counts, that a part with lost characters may have been.

    The parts of one skeleton (characters beyond ASCII left open) differ in where characters are lost; each word of the skeleton is hidden at those places
    and compared as a whole, so no part is held against each word.
    """
    part = of.select(F.explode("gaps").alias("gap")).distinct().where("length(gap) >= 2")
    shape = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", LOST)
    part = part.select("gap", shape("gap").alias("shape"), F.expr(f"transform(split(gap, ''), x -> x = '{LOST}')").alias("mask"))
    masks = part.select("shape", "mask").distinct()
    words = counts.where(rf"unit rlike '^\\p{{L}}' and not contains(unit, '{LOST}')").select("unit", "docs", shape("unit").alias("shape"))
    hidden = F.expr(f"array_join(transform(split(unit, ''), (c, i) -> if(mask[i], '{LOST}', c)), '')")
    fits = words.join(masks, "shape").select(hidden.alias("gap"), "unit", "docs")
    fits = fits.join(part.select("gap"), "gap", "left_semi")
    first = fits.groupBy("gap").agg(F.max(F.struct("docs", F.col("unit"))).alias("a"))
    second = fits.join(first, "gap").where("unit <> a.unit").groupBy("gap").agg(F.max(F.struct("docs", F.col("unit"))).alias("b"))
    return first.join(second, "gap", "left").select("gap", F.array_compact(F.array("a", "b")).alias("words"))


JUDGED = "token string, best struct<channel:string,text:string,gain:double,weight:double>, others array<struct<channel:string,text:string,gain:double>>"


def token_readings(of: DataFrame, counts: DataFrame, docs: int) -> DataFrame:
    """token, best, others (see Scores.judge) of the tokens that a channel explains better. Each token is judged with the counts of just its units."""
    # only units of the model get through the join, a few for each token
    known = of.select("token", F.explode("units").alias("unit")).join(counts, "unit").groupBy("token").agg(F.collect_list(F.struct("unit", "docs")).alias("known"))
    gaps = of.where("size(gaps) > 0").select("token", F.explode("gaps").alias("gap")).join(lost_words(of, counts), "gap")
    gaps = gaps.groupBy("token").agg(F.collect_list(F.struct("gap", "words")).alias("lost"))
    rows = of.select("token", "readings").join(known, "token", "left").join(gaps, "token", "left")
    letters = of.sparkSession.sparkContext.broadcast(letter_counts(counts))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for token, readings, known, lost in zip(part["token"], part["readings"], part["known"], part["lost"]):
                counts = {x["unit"]: x["docs"] for x in (known if known is not None else ())}
                words = {}
                for x in lost if lost is not None else ():
                    words[x["gap"]] = [w["unit"] for w in x["words"]]
                    counts |= {w["unit"]: w["docs"] for w in x["words"]}
                    # a word may hold characters that are units of their own, as mm² does
                    counts |= {u: letters.value[u] for w in x["words"] for u in token_units(w["unit"]) - counts.keys() if u in letters.value}
                best, others = Scores(docs, counts).judge(token, [(x["channel"], x["text"], x["price"]) for x in readings], words)
                if best or others:
                    out.append((token, best, others))
            yield pd.DataFrame(out, columns=["token", "best", "others"])

    return rows.mapInPandas(judge, JUDGED)


def judged(of: DataFrame, readings: DataFrame) -> DataFrame:
    """of(doc_id, tokens) to doc_id, fixes (token to text) of the documents in which some channel is sure.

    A channel is sure where its readings gain enough over the document's distinct tokens; every other token then follows the sure channels, be it too
    short or too frequent to tell its own. What is gathered for a document is bounded by its tokens.
    """
    hits = of.select("doc_id", F.explode("tokens").alias("token")).join(readings, "token")
    each = hits.groupBy("doc_id").agg(F.collect_list(F.struct("token", "best", "others")).alias("hits")).where("exists(hits, h -> h.best is not null)")
    told = each.withColumn("told", F.expr("filter(hits, h -> h.best is not null)"))
    sure = f"filter(array_distinct(told.best.channel), c -> aggregate(filter(told, h -> h.best.channel = c), 0D, (a, h) -> a + h.best.gain * h.best.weight) >= {CHANNEL_GAIN})"
    told = told.withColumn("sure", F.expr(sure)).where("size(sure) > 0")
    follow = "array_max(transform(filter(h.others, o -> array_contains(sure, o.channel)), o -> struct(o.gain, o.text))).text"
    text = f"if(array_contains(sure, h.best.channel), h.best.text, {follow})"
    fixes = F.expr(f"filter(transform(hits, h -> struct(h.token as token, {text} as text)), x -> x.text is not null)")
    return told.select("doc_id", F.map_from_entries(fixes).alias("fixes"))


def corrected(counts: DataFrame, fixed: DataFrame) -> DataFrame:
    """The counts of tokens with those that a channel explains counted as what stands behind them."""
    swaps = fixed.select(F.explode("fixes").alias("token", "text")).groupBy("token", "text").agg(F.count("*").alias("docs"))
    both = swaps.select(F.explode(F.array(F.struct("token", (-F.col("docs")).alias("docs")), F.struct(F.col("text").alias("token"), "docs"))).alias("x")).select("x.*")
    return counts.unionAll(both).groupBy("token").agg(F.sum("docs").alias("docs")).where("docs > 0")


def damaged_ids(documents: DataFrame) -> DataFrame:
    """doc_id, fixes (damaged tokens to their text, null where nothing can be told), lost (whether a character is lost) of the damaged documents.

    Counted twice: as the texts stand, then with what the first model finds damaged as restored, so that frequent damage doesn't pass for the source.
    """
    docs = documents.count()
    of = written(document_tokens(documents), "document-tokens")
    tokens = written(of.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("docs")), "tokens")
    counts = written(unit_counts(tokens), "unit-counts")
    readings = written(candidates(tokens, docs, letter_counts(counts)), "readings")
    first = judged(of, written(token_readings(readings, counts, docs), "first-judged"))
    counts = written(unit_counts(corrected(tokens, first)), "unit-counts")
    found = judged(of, written(token_readings(readings, counts, docs), "judged"))
    lost = of.where(F.exists("tokens", lambda t: F.contains(t, F.lit(LOST)))).select("doc_id", F.lit(None).cast("map<string,string>").alias("fixes"), F.lit(True).alias("lost"))
    both = found.select("doc_id", "fixes", F.lit(False).alias("lost")).unionByName(lost)
    return both.groupBy("doc_id").agg(F.first("fixes", ignorenulls=True).alias("fixes"), F.max("lost").alias("lost"))


FOUND = "doc_id bigint, tokens int, restored string, complete boolean"


def damaged(documents: DataFrame) -> DataFrame:
    """doc_id, tokens (distinct damaged ones), restored (the text with them replaced), complete (no lost character is left) of the damaged documents.

    Null and empty texts are never damaged. A replacement character is damage, recoverable or not. Documents are read whole. Rows without doc_id are left
    out; rows that share a doc_id are judged as one document, and each is restored.
    """
    found = written(damaged_ids(documents), "damaged")  # its size is known to the join: small, it is sent to the texts; else only their bloom filter is

    def restore(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fixes = [dict(x) if x is not None else {} for x in part["fixes"]]
            texts = [replaced(t, f) if f else t for t, f in zip(part["text"], fixes)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": [len(f) for f in fixes], "restored": texts, "complete": [LOST not in t for t in texts]})

    return documents.where("text is not null").select("doc_id", "text").join(found.select("doc_id", "fixes"), "doc_id").mapInPandas(restore, FOUND)
