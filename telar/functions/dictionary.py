"""Finding the entries of a dictionary in texts with one automaton, whatever the number of entries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HITS = "array<struct<raw:string,offset:int>>"


@lru_cache(1 << 16)
def in_word(c: str) -> bool:
    """Letters, marks, digits, connectors and joiners, as Unicode word patterns take them."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Me", "Mc", "Nd", "Nl", "Pc") or c in "‌‍"


@lru_cache(1 << 16)
def low(c: str) -> str:
    """Lower case that never changes a text's length."""
    x = c.lower()
    return x if len(x) == 1 else c


class Dictionary:
    """Whole-word entries of a text in any case: from the left, the longest that begins at a place, without overlaps."""

    def __init__(self, entries: Iterable[str]):
        import ahocorasick

        self.every = ahocorasick.Automaton()
        for e in entries:
            self.every.add_word("".join(map(low, e)), len(e))
        self.every.make_automaton()

    def find(self, text: str) -> list[tuple[str, int]]:
        folded = text.lower()
        if len(folded) != len(text):
            folded = "".join(map(low, text))
        longest: dict[int, int] = {}
        for last, n in self.every.iter(folded):
            start, end = last + 1 - n, last + 1
            if not (start and in_word(text[start - 1])) and not (end < len(text) and in_word(text[end])):
                longest[start] = max(end, longest.get(start, 0))
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                at = longest[start]
                out.append((text[start:at], start))
        return out


def dictionary_hits(text: Column, entries: list[str]) -> Column:
    """Array of (raw, offset) of the entries in a text; null where it has none. A task builds the automaton once from the broadcast entries."""
    sent = SparkSession.active().sparkContext.broadcast(sorted(set(entries)))

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        every = Dictionary(sent.value)
        for texts in batches:
            found = ([{"raw": r, "offset": o} for r, o in every.find(t)] if t else [] for t in texts)
            yield pd.Series([x or None for x in found], dtype=object)

    return find(text)
