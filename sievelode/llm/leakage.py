"""Problem 6: passages of held-out evaluation items in a training corpus.

Method (pigeonhole edit matching): an item is cut into short pieces so that every passage of the wanted length holds
one piece more than the error budget; at least one of them stands unharmed in a corpus document that has the passage.
Exact piece hits are found with an automaton, and the passage around a hit is verified with Myers' bit-parallel edit
distance. The longest exact run at a hit is reported too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def units_of(text: str | None) -> list[str]:
    """Words in lower case: runs of letters or digits; compatibility forms and composed accents are made alike."""
    return _WORD.findall(unicodedata.normalize("NFKC", text or "").lower())


def is_dense(text: str | None) -> bool:
    """Whether characters are the units: more letters of a script without spaces than words of other scripts."""
    dense = len(_DENSE.findall(text or ""))
    return dense > sum(not _DENSE.search(w) for w in units_of(text))


def piece_length(passage: int, errors: int) -> int:
    """Units of a piece so that each passage holds ``errors + 1`` whole pieces of a fixed tiling."""
    size = (passage + 1) // (errors + 2)
    if size < 1:
        raise ValueError("the error budget is too large for the passage")
    return size


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """Least edit distance between the pattern and any part of the text (Myers' bit-parallel algorithm over units)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, unit in enumerate(pattern):
        masks[unit] = masks.get(unit, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for unit in text:
        eq = masks.get(unit, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | ~(horizontal | plus) & full
        h_minus = plus & horizontal
        if h_plus & high:
            score += 1
        elif h_minus & high:
            score -= 1
        h_plus = h_plus << 1 & full
        h_minus = h_minus << 1 & full
        plus = h_minus | ~(vertical | h_plus) & full
        minus = h_plus & vertical
        best = min(best, score)
    return best


class Pieces:
    """The pieces of a block of items, as one automaton for words and one for characters."""

    def __init__(self, items: list[tuple[int, str]], words: int, chars: int, errors: int) -> None:
        self.items, self.words, self.chars, self.errors = items, words, chars, errors
        self._built = False

    def build(self) -> None:
        if self._built:
            return
        self.units: list[list[str]] = []
        self.by_word, self.by_char = ahocorasick.Automaton(), ahocorasick.Automaton()
        for n, (_, text) in enumerate(self.items):
            dense = is_dense(text)
            units = units_of(text)
            units = list("".join(units)) if dense else units
            self.units.append(units)
            size = piece_length(self.chars if dense else self.words, self.errors)
            automaton = self.by_char if dense else self.by_word
            for at in range(0, len(units) - size + 1, size):
                piece = "".join(units[at : at + size]) if dense else f" {' '.join(units[at : at + size])} "
                automaton.add_word(piece, [*automaton.get(piece, []), (n, at, size)])
        for automaton in (self.by_word, self.by_char):
            if len(automaton):
                automaton.make_automaton()
        self._built = True

    def __getstate__(self):
        return self.items, self.words, self.chars, self.errors

    def __setstate__(self, state):
        self.__init__(*state)

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item, least distance of a passage, longest exact run)`` of each item of which a passage is in the text."""
        self.build()
        words = units_of(text)
        if not words:
            return []
        hits: dict[tuple[int, int], tuple[bool, set[int]]] = {}
        if len(self.by_word):
            line = f" {' '.join(words)} "
            ends, total = {}, 0
            for i, w in enumerate(words):
                total += len(w) + 1
                ends[total] = i
            for end, found in self.by_word.iter(line):
                for n, at, size in found:
                    hits.setdefault((n, ends[end] - size + 1 - at), (False, set()))[1].add(at)
        if len(self.by_char) and _DENSE.search(text):
            flat = "".join(words)
            for end, found in self.by_char.iter(flat):
                for n, at, size in found:
                    hits.setdefault((n, end - size + 1 - at), (True, set()))[1].add(at)
        best: dict[int, tuple[int, int]] = {}
        letters: list[str] | None = None
        for (n, shift), (dense, places) in hits.items():
            item, want = self.units[n], self.chars if dense else self.words
            if dense and letters is None:
                letters = list("".join(words))
            body = letters if dense else words
            size = piece_length(want, self.errors)
            run, seen = 0, set()
            for at in sorted(places):
                if at in seen:
                    continue
                a, b = at, at + size
                while a > 0 and a + shift > 0 and item[a - 1] == body[a - 1 + shift]:
                    a -= 1
                while b < len(item) and b + shift < len(body) and item[b] == body[b + shift]:
                    b += 1
                seen.update(range(a, b))
                run = max(run, b - a)
            old = best.get(n, (self.errors + 1, 0))
            distance = 0 if run >= want else old[0]
            if distance and self.errors:
                for at in places:
                    for start in range(max(0, at + size - want), min(at, len(item) - want) + 1):
                        part = body[max(0, start + shift - self.errors) : start + shift + want + self.errors]
                        distance = min(distance, myers_distance(item[start : start + want], part))
                    if not distance:
                        break
            best[n] = (min(old[0], distance), max(old[1], run))
        return [(self.items[n][0], d, run) for n, (d, run) in best.items() if d <= self.errors]


def leaked(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    words: int = 12, chars: int = 20, errors: int = 1, block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per document and item of which a passage leaked: ``key``, ``item_key``, ``distance``, ``exact_run``.

    A passage has ``words`` consecutive words of the item, or ``chars`` characters for items in Chinese or Japanese; it
    is found with at most ``errors`` words (characters) inserted, left out or changed. ``exact_run`` is the longest run
    of units that agree at a hit. Case, punctuation, markup and spacing do not matter. Null and empty texts and items
    shorter than a passage give no rows; repeated rows give theirs once.

    Test items are few: they go to the tasks in blocks of at most ``block_chars`` characters, so that no broadcast grows
    beyond that; the corpus is read once a block and never shuffled.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    test = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null and i is not null").distinct()
    schema = "k long, i long, distance int, exact_run int"

    def against(pieces: Pieces) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(pieces)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(k, *m) for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in shared.value.matches(body)]
                columns = list(zip(*out, strict=True)) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "i", "distance", "exact_run"])

        return rows.mapInArrow(scan, schema)

    found, block, size = None, [], 0
    for row in test.orderBy("i", "t").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= block_chars:
            part = against(Pieces(block, words, chars, errors))
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
    if block or found is None:
        part = against(Pieces(block, words, chars, errors))
        found = part if found is None else found.unionByName(part)
    return (
        found.groupBy("k", "i").agg(F.min("distance").alias("distance"), F.max("exact_run").alias("exact_run"))
        .withColumnsRenamed({"k": key, "i": item_key})
    )
