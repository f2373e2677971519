"""Counts over the words and lines of a text, shared by the quality operators."""

from __future__ import annotations

import re

import numpy as np

from .common import WORD

WORDS = re.compile(WORD)
SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    if len(codes) == len(words):
        return 0
    # ranks of windows of 1, 2, 4, ... words: exact, no hashing
    rank, span = ids, 1
    while span < window:
        step = min(span, window - span)
        key = rank[: len(words) - span - step + 1] * (int(rank.max()) + 1) + rank[step : len(words) - span + 1]
        values, rank, counts = np.unique(key, return_inverse=True, return_counts=True)
        span += step
        if len(values) == len(key):
            return 0
    twice = counts[rank] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += WORDS.search(line) is not None
        else:
            seen.add(line)
    return n
