"""Recompression: rounds that name runs and pairs of a token sequence.

A name is a 64-bit hash of what it stands for, so every task gives the same name to the same run or pair, and no
dictionary has to be exchanged between the rounds. Which neighbours form a pair is read off the names alone (Jez's
split of the alphabet into left and right letters, here by a hash bit), so equal substrings are parsed into equal
symbols but for a few at their edges. How far the edge reaches is kept for each symbol as the range of words that
its existence depends on: a symbol whose range lies within a substring is found in every copy of the substring.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from spoor.llm.tokens import U64, Spans, mix, mix_int


class Symbols(NamedTuple):
    """name; words ``start : end``; the first and last word that the symbol depends on (maybe outside the text)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def name_runs(names: np.ndarray, text: np.ndarray) -> Symbols:
    """Maximal runs of one token within one text. A run depends on the token before it and the one after it."""
    n = len(names)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Symbols(names, none, none, none, none, none)
    begin = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[begin[1:], n]
    name = mix(names[begin] ^ mix((end - begin).astype(U64)))
    return Symbols(name, begin, end, begin - 1, end, text[begin])


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Pairs of a left and a right letter become one symbol; the others stay as they are."""
    n = len(s.name)
    if n < 2:
        return s
    right = (mix(s.name ^ U64(mix_int(7919 + level))) & U64(1)).astype(bool)
    same = s.text[1:] == s.text[:-1]
    joined = np.r_[~right[:-1] & right[1:] & same, False]
    first = np.flatnonzero(~np.r_[False, joined[:-1]])
    pair = joined[first]
    last = first + pair
    # A right letter could have joined the letter before it, a left letter the one after it.
    before = np.where(right[first] & np.r_[False, same][first], first - 1, first)
    after = np.where(~right[last] & np.r_[same, False][last], last + 1, last)
    low, high = s.low[before], s.high[after]
    # At a text's edge the neighbour is missing, which a window inside the text cannot tell.
    low = np.where(right[first] & ~np.r_[False, same][first], s.start[first] - 1, low)
    high = np.where(~right[last] & ~np.r_[same, False][last], s.end[last], high)
    name = np.where(pair, mix(s.name[first] + mix(s.name[last] ^ U64(mix_int(level)))), s.name[first])
    return Symbols(name, s.start[first], s.end[last], low, high, s.text[first])


class Groups(NamedTuple):
    """Runs of neighbouring windows that are found by the same symbol.

    anchor: name of the symbol and of all that it depends on; content: name of all words of the run's windows;
    start: first word of the first window; count: windows; text: the text that they are in.
    """

    anchor: np.ndarray
    content: np.ndarray
    start: np.ndarray
    count: np.ndarray
    text: np.ndarray


def window_groups(names: np.ndarray, first: np.ndarray, window: int, levels: int) -> tuple[Groups, Spans]:
    """Every window of ``window`` words of every text, grouped by its least symbol after ``levels`` rounds.

    The symbol is chosen among those whose range lies within the window, so it is a function of the window's words.
    A window without such a symbol (within a long run) is found by its own name.
    names: the words' names; first: the texts' first words, and the end.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    spans = Spans(names)
    windows = np.maximum(counts - (window - 1), 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return Groups(none.astype(U64), none.astype(U64), none, none, none), spans
    which = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)
    symbols = name_runs(names, text)
    for level in range(levels):
        symbols = name_pairs(symbols, level)
    short = (symbols.low >= 0) & (symbols.high < len(names)) & (symbols.high - symbols.low < window)
    short &= (symbols.low >= first[symbols.text]) & (symbols.high < first[symbols.text + 1])
    low, high = symbols.low[short], symbols.high[short]
    key = spans(low, high - low + 1)
    left = np.searchsorted(low, at, side="left")
    stop = np.searchsorted(high, at + window - 1, side="right")
    best = np.full(total, -1, dtype=np.int64)
    best_key = np.full(total, ~U64(0), dtype=U64)
    rows, index = np.arange(total), left
    while len(rows):
        live = index < stop[rows]
        rows, index = rows[live], index[live]
        better = key[index] < best_key[rows]
        best[rows[better]], best_key[rows[better]] = index[better], key[index[better]]
        index = index + 1
    own = best < 0
    best_key[own] = spans(at[own], window)
    begin = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | own[1:] | (which[1:] != which[:-1])])
    count = np.diff(np.r_[begin, total])
    start = at[begin]
    # Contents have hashes of their own, which say nothing of the anchors'.
    return Groups(best_key[begin], Spans(names, 1)(start, count + window - 1), start, count, which[begin]), spans
