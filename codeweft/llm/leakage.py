"""Evaluation passages inside training documents.

Both sides are brought to plain words: compatibility forms, accents, look-alike letters, invisible characters, markup, case,
punctuation and line breaks inside words no longer matter. What is looked for is a stretch of two fifths of an item (L words)
with a budget of ERRORS * L errors. Wherever in the item the stretch begins, it is split into budget-plus-one pieces of
q = L / (budget + 1) words; an error spoils one piece at most, so one at least stands unchanged in the document. The pieces of
all stretches are the item's runs of q words, and exact hits of these find every candidate. Of the L - q + 1 runs within a
stretch each error spoils q at most; so only places are kept at which as many as are left over stand, in the item's order.
They are verified by Myers' bit-parallel edit distance over words, for every stretch with hits enough (after a common
subsequence, bit-parallel too, has ruled out those that can't be that near). A word that no item has counts as the item's word
from which it differs by a letter or two.

Test items are a stated query set: they reach the tasks in blocks of bounded numbers and bytes, one block after the other, each
against all documents; only the block at work is on the driver and in the tasks.

Defined results: null, empty and blank texts hold nothing; an item without words is found nowhere; items that share a
passage are each found; repeated rows of documents or items give one row per pair of ids. A null id gives no row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Part of an item's words that makes a case.
SHARE = 0.4
#: Part of the compared words that may differ.
ERRORS = 0.4
#: Items of a block, and characters of their texts, on average.
BLOCK, BLOCK_CHARS = 20_000, 20_000_000

# fixed values: letters of other scripts that look like Latin ones
_ALIKE = str.maketrans("аеорсухіјѕԁһӏвкмнтАЕОРСУХІЈЅВКМНТαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtaeopcyxijsbkmhtaovpabezhikmnoptyx")
_OTHER_SCRIPT = re.compile("[" + chr(0x370) + "-" + chr(0x52F) + "]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BREAK = re.compile(r"(?<=[a-z])-[ \t]*\r?\n[ \t>#*/|]*(?=[a-z])")
_ASCII_WORD = re.compile(r"[a-z0-9]+").findall
_WORD = re.compile(r"[^\W_]+").findall


def plain_words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    plain = text.isascii()
    if not plain:
        if _OTHER_SCRIPT.search(text):
            text = text.translate(_ALIKE)
        text = unicodedata.normalize("NFKD", text)
        if not (plain := text.isascii()):
            text = "".join([c for c in text if c < "\x80" or unicodedata.category(c) not in ("Mn", "Cf")])
    text = text.lower()
    if "-\n" in text or "-\r\n" in text or "- \n" in text:
        text = _BREAK.sub("", text)
    return (_ASCII_WORD if plain else _WORD)(text)


def distance(pattern: int, masks: list[int]) -> int:
    """Least edit distance of a pattern of `pattern` symbols to any part of a text (Myers 1999, as by Hyyrö 2001).

    masks: for each symbol of the text the bits of the pattern's places that equal it.
    """
    if pattern == 0:
        return 0
    full, top = (1 << pattern) - 1, 1 << (pattern - 1)
    up, down, score, best = full, 0, pattern, pattern
    for eq in masks:
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (~(diagonal | up) & full), up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(diagonal | rise) & full), rise & diagonal
    return best


def common(pattern: int, masks: list[int]) -> int:
    """Length of a longest common subsequence, by the same masks."""
    full = (1 << pattern) - 1
    row = full
    for m in masks:
        if m:
            hit = row & m
            row = ((row + hit) | (row & ~m)) & full
    return pattern - row.bit_count()


def whole_distance(a: str, b: str) -> int:
    """Edit distance of two short words, bit-parallel, with the start of b bound."""
    if not a:
        return len(b)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (~(diagonal | up) & full), up & diagonal
        score += 1 if rise & top else -1 if fall & top else 0
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (~(diagonal | rise) & full), rise & diagonal
    return score


def _near(a: str, b: str) -> bool:
    """Typing slips: one letter in words of four to seven, two in longer ones; two letters swapped count as one slip."""
    n = min(len(a), len(b))
    if n < 3 or abs(len(a) - len(b)) > 2 :
        return False
    return whole_distance(a, b) <= (1 if n < 8 else 2) or (len(a) == len(b) and sorted(a) == sorted(b) and whole_distance(a, b) <= 2)


def _remainders(word: str) -> set[str]:
    """The word, and it without one letter, or without two if it is long; words under four or over 24 letters have none."""
    if not 4 <= len(word) <= 24:
        return set()
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | one | ({w[:i] + w[i + 1 :] for w in one for i in range(len(w))} if len(word) > 7 else set())


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [plain_words(t) for _, t in items]
        self.number: dict[str, int] = {}
        for ws in self.words:
            for w in ws:
                self.number.setdefault(w, len(self.number) + 1)
        self.base = len(self.number) + 1
        #: words of the stretch, its budget of errors, words of a piece, and runs of a piece's length that must be left
        self.least = [max(1, -(-2 * len(ws) // 5)) if len(ws) > 5 else len(ws) for ws in self.words]
        self.budget = [int(ERRORS * n) for n in self.least]
        self.piece = [1 if n < 2 * (k + 1) else 2 for n, k in zip(self.least, self.budget)]
        self.left = [max(1, n - q + 1 - k * q) for n, k, q in zip(self.least, self.budget, self.piece)]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            n = [self.number[w] for w in ws]
            for at in range(len(n) - self.piece[k] + 1):
                places[n[at] * self.base + (n[at + 1] if self.piece[k] == 2 else 0)].append((k, at))
        self.single = any(q == 1 and ws for q, ws in zip(self.piece, self.words))
        self.keys = np.array(sorted(places), np.int64)
        self.places = [places[int(k)] for k in self.keys]
        self.alike: dict[str, list[str]] = {}
        #: words by what remains without up to two of their letters: words two slips apart share one such remainder
        self.remainders: dict[str, list[str]] = defaultdict(list)
        for w in self.number:
            for r in _remainders(w):
                self.remainders[r].append(w)
        self.bits: dict[int, dict[str, int]] = {}

    def mask(self, k: int, word: str) -> int:
        if (bits := self.bits.get(k)) is None:
            bits = self.bits[k] = defaultdict(int)
            for i, w in enumerate(self.words[k]):
                bits[w] |= 1 << i
        if word in bits:
            return bits[word]
        if word in self.number:
            return 0
        if (near := self.alike.get(word)) is None:
            near = [w for w in {w for r in _remainders(word) for w in self.remainders.get(r, ())} if _near(word, w)]
            if len(self.alike) > 500_000:
                self.alike.clear()
            self.alike[word] = near
        found = 0
        for w in near:
            found |= bits[w] if w in bits else 0
        return found

    def verified(self, k: int, words: list[str], hits: list[tuple[int, int]]) -> bool:
        """hits: (place in the document, place in the item), one candidate's, by place in the document."""
        reach, left = self.least[k] + self.budget[k], self.left[k]
        low, start, upto = 0, None, 0
        for high in range(len(hits)):
            while hits[high][0] - hits[low][0] > reach:
                low += 1
            if high - low + 1 < left:
                continue
            # stretches of the document with hits enough; those that overlap are one
            if start is not None and low >= upto:
                if self._passage(k, words, hits[start:upto]):
                    return True
                start = None
            start = low if start is None else start
            upto = high + 1
        return start is not None and self._passage(k, words, hits[start:upto])

    def _passage(self, k: int, words: list[str], hits: list[tuple[int, int]]) -> bool:
        n, size, budget, left = len(self.words[k]), self.least[k], self.budget[k], self.left[k]
        if _longest_ascending(hits) < left:
            return False
        there = np.zeros(n + 1, np.int64)
        there[[p + 1 for p in {p for _, p in hits}]] = 1
        upto = np.cumsum(there)
        # runs that begin within the stretch and end in it
        inside = upto[size - self.piece[k] + 1 :][: n - size + 1] - upto[: n - size + 1]
        starts = np.flatnonzero(inside >= left).tolist()
        if not starts:
            return False
        first, last = max(0, hits[0][0] - size - budget), hits[-1][0] + 2 + size + budget
        masks = [self.mask(k, w) for w in words[first:last]]
        if common(n, masks) < size - budget:
            return False
        full = (1 << size) - 1
        for s in sorted(starts, key=lambda s: -inside[s]):
            own = [(m >> s) & full for m in masks]
            if common(size, own) >= size - budget and distance(size, own) <= budget:
                return True
        return False

    def found(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the places (in this block) of the items it holds."""
        words = [plain_words(t) if t else [] for t in texts]
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        flat = np.zeros(int(lengths.sum()) + 1, np.int64)
        get, at = self.number.get, 0
        for w in words:
            flat[at : at + len(w)] = [get(x, 0) for x in w]
            at += len(w) + 1
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.keys):
            return out
        starts = np.concatenate([[0], np.cumsum(lengths)])
        here, after = flat[:-1], flat[1:]
        by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for asked in [np.where((here > 0) & (after > 0), here * self.base + after, -1)] + ([np.where(here > 0, here * self.base, -1)] if self.single else []):
            where = np.searchsorted(self.keys, asked)
            where[where == len(self.keys)] = 0
            hit = np.nonzero(self.keys[where] == asked)[0]
            doc = np.searchsorted(starts, hit, "right") - 1
            for x, d, w, s in zip(hit.tolist(), doc.tolist(), where[hit].tolist(), starts[doc].tolist()):
                for k, place in self.places[w]:
                    by[(d, k)].append((x - s, place))
        for (d, k), hits in by.items():
            if len(hits) >= self.left[k] and self.verified(k, words[d], hits):
                out[d].append(k)
        return out


def _longest_ascending(hits: list[tuple[int, int]]) -> int:
    """Length of a longest chain of hits that ascends in both places; of hits at one place of the document one counts."""
    tails: list[int] = []
    for _, p in sorted(hits, key=lambda h: (h[0], -h[1])):
        j = bisect_left(tails, p)
        if j == len(tails):
            tails.append(p)
        else:
            tails[j] = p
    return len(tails)


_BLOCKS: dict[int, Items] = {}


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds two fifths of an item's words in the item's order and one passage."""
    spark = documents.sparkSession
    texts = items.where("item_id is not null and text is not null").select("item_id", "text")
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    seen = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-seen["n"] // BLOCK), -(-(seen["chars"] or 0) // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        block = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        own = sorted({(r["item_id"], r["text"]) for r in block.collect()})
        shared = spark.sparkContext.broadcast((hash(tuple(own)), own))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            key, own = shared.value
            if key not in _BLOCKS:
                _BLOCKS.clear()
                _BLOCKS[key] = Items(own)
            ready = _BLOCKS[key]
            for batch in batches:
                docs, out = batch.column(0).to_pylist(), ready.found(batch.column(1).to_pylist())
                pairs = [(d, ready.ids[k]) for d, ks in zip(docs, out) for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.int64())], names=["doc_id", "item_id"])

        found = rows.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()
        if blocks == 1:
            return found
        found = cut(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
