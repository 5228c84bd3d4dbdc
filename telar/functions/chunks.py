"""Chunkers: sequential folds over a text, as vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_paragraphs(text: str | None, size: int) -> list[str]:
    """Whole paragraphs packed up to `size`; longer ones are packed by sentences, of which one may exceed it."""
    out, held = [], ""
    for p in filter(None, map(str.strip, re.split(r"\n\n+", text or ""))):
        if len(held) + len(p) + 2 <= size:
            held = f"{held}\n\n{p}".strip()
            continue
        if held:
            out.append(held)
        if len(p) <= size:
            held = p
            continue
        last = ""
        for s in re.split(r"(?<=[.!?])\s+", p):
            if len(last) + len(s) + 1 <= size:
                last = f"{last} {s}".strip()
            else:
                out += [last] if last else []
                last = s
        held = last or held
    return out + ([held] if held else [])


def split_recursively(text: str, size: int, overlap: int, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest mark that serves, neighbours sharing up to `overlap`."""
    mark = next(m for m in marks if m == "" or m in text)
    finer = marks[marks.index(mark) + 1 :]
    pieces = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if whole := mark.join(run).strip():
            out.append(whole)

    total = 0
    for p in pieces:
        if len(p) > size and finer:
            close()
            run, total = [], 0
            out += split_recursively(p, size, overlap, finer)
            continue
        gap = len(mark) if run else 0
        if run and total + gap + len(p) > size:
            close()
            while run and (total > overlap or total + len(mark) + len(p) > size):
                total -= len(run.pop(0)) + (len(mark) if run else 0)
        total += len(p) + (len(mark) if run else 0)
        run.append(p)
    close()
    return out


def semantic_chunks(text: Column, size: int = 1000) -> Column:
    @F.pandas_udf("array<string>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_paragraphs(t, size))

    return fold(text)


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    @F.pandas_udf("array<string>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return fold(text)
