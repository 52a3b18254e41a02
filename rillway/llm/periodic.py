"""Periodic runs of words by recompression.

All texts of a slice become one grammar: rounds alternate block compression (a stretch of one symbol becomes one symbol)
and pair compression (symbols are split in two halves by a hash; a pair of a left and a right one becomes one symbol), until
each text is one symbol. Symbols are named by what they stand for, so equal stretches are parsed alike but at their ends,
and a longest common extension of two places is found by going up the rounds while the symbols at both agree and down again
at the first that differ. Candidates are the places of a harmonic grid (for each period q a place in 2q words or so, so
that each run holds one of them and the word q further on) where a word recurs q words on; their extensions to both sides
give the runs exactly, without a suffix array.

A run is a stretch of words with smallest period q, `times` * q words or more and at least `least`, that no neighbouring
word extends keeping period q.

Defined results: a null or empty text has no words and no runs; repeated rows give repeated results; null ids are as good as
any; long texts are searched whole; columns beside the id and the text are ignored, whatever their names, and an id named
like a result is a ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillway.llm.common import byte_words, exact_ids, mix64, over_texts, picked, text_bytes

WORD_BYTES = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Candidates held at once, and words up to which the grid is kept from text to text.
CANDIDATES, KEPT_WORDS = 1 << 20, 4096


@dataclass
class Round:
    """The symbols of a round, and how the next round groups them: `parent` of each, `first` of each group (and the end)."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    pairs: bool

    def mirrored(self) -> Round:
        n, groups = len(self.symbols), len(self.first) - 1
        return Round(self.symbols[::-1], groups - 1 - self.parent[::-1], n - self.first[::-1], self.pairs)


def _grouped(symbols: np.ndarray, starts: np.ndarray, pairs: bool) -> Round:
    first = np.append(np.flatnonzero(starts), len(symbols))
    return Round(symbols.astype(np.int32), np.cumsum(starts, dtype=np.int32) - 1, first.astype(np.int32), pairs)


def _named(number: np.ndarray, key: np.ndarray, base: int) -> np.ndarray:
    """number with the entries of `key` >= 0 replaced by new names from `base` on, equal for equal keys."""
    at = np.flatnonzero(key >= 0)
    number[at] = base + np.unique(key[at], return_inverse=True)[1]
    return number


def recompress(words: np.ndarray, size: int) -> list[Round]:
    """The rounds for words numbered from 1 below `size`, where 0 stands between texts and at both ends."""
    rounds: list[Round] = []
    symbols, salt = words.astype(np.int64), 0
    while True:
        gap = symbols == 0
        if (gap[1:] | gap[:-1]).all():
            return rounds
        same = (symbols[1:] == symbols[:-1]) & ~gap[1:]
        if same.any():
            step = _grouped(symbols, np.append(True, ~same), False)
            held, count = symbols[step.first[:-1]], np.diff(step.first)
            _, short = np.unique(count, return_inverse=True)
            fresh = _named(held.copy(), np.where((count > 1) & (held > 0), held * (short.max() + 1) + short, -1), size)
        else:
            # Both ways of calling a half left, and the one that pairs more.
            salt += 1
            half = (mix64(symbols ^ (salt << 40)) & np.uint64(1)).astype(bool)
            a, b = half[:-1], half[1:]
            inside = ~gap[1:] & ~gap[:-1]
            left, right = a & ~b & inside, ~a & b & inside
            joined = left if np.count_nonzero(left) >= np.count_nonzero(right) else right
            if not joined.any():
                continue
            step = _grouped(symbols, np.append(True, ~joined), True)
            heads = step.first[:-1]
            held, two = symbols[heads], np.diff(step.first) == 2
            key = np.where(two, held * size + symbols[np.minimum(heads + 1, len(symbols) - 1)], -1)
            fresh = _named(held.copy(), key, size)
        size = max(size, int(fresh.max()) + 1)
        rounds.append(step)
        symbols = fresh


def extensions(rounds: list[Round], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x and from y on are equal. x < y lie in one text of which `rounds` is the grammar: y meets the
    text's end first."""
    begin, x, y = x, x.copy(), y.copy()
    top = np.full(len(x), len(rounds))
    now = np.arange(len(x))
    for k, r in enumerate(rounds):
        a, b = x[now], y[now]
        head = (r.first[r.parent[a]] == a) & (r.first[r.parent[b]] == b)
        same = head | (r.symbols[a] == r.symbols[b])
        left, right = r.first[r.parent[a] + 1] - a, r.first[r.parent[b] + 1] - b
        if r.pairs:  # the second of a pair, alone or not, is followed by the head of a group
            left, right = np.ones_like(left), np.ones_like(right)
        step = np.where(same & ~head, np.minimum(left, right), 0)
        up = same & (head | (left == right))
        a, b = a + step, b + step
        x[now], y[now] = np.where(up, r.parent[np.minimum(a, len(r.parent) - 1)], a), np.where(up, r.parent[np.minimum(b, len(r.parent) - 1)], b)
        top[now[~up]] = k
        now = now[up]
        if not len(now):
            break
    # Down: where symbols of the round above differ, their first parts may agree, once.
    order = np.argsort(-top, kind="stable")
    levels = -top[order]
    for k in range(int(top.max(initial=0)) - 1, -1, -1):
        at, r = order[: np.searchsorted(levels, -k, side="left")], rounds[k]
        px, py = x[at], y[at]
        a, b = r.first[px], r.first[py]
        same = r.symbols[a] == r.symbols[b]
        step = np.minimum(r.first[px + 1] - a, r.first[py + 1] - b)
        if r.pairs:
            step = np.minimum(step, 1)
        x[at], y[at] = a + same * step, b + same * step
    return x - begin


def _grid(words: int, low: int, high: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, period and words needed, for periods from low below high of texts of up to `words` words."""
    periods = np.arange(low, high)
    need = np.maximum(least, times * periods)
    steps = need - periods
    counts = np.maximum(-(-(words - periods) // steps), 0) * (need <= words)
    q, step, need = np.repeat(periods, counts), np.repeat(steps, counts), np.repeat(need, counts)
    place = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return place, q, np.maximum(need, place + q + 1)


@functools.cache
def _kept_grid(least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of texts of KEPT_WORDS words, by the words that a text must have for a candidate to lie in it."""
    place, q, need = _grid(KEPT_WORDS, 1, KEPT_WORDS // times + 1, least, times)
    order = np.argsort(need, kind="stable")
    return place[order], q[order], need[order]


def candidates(first: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """text, place and period of the grid's candidates, in parts of bounded size. first, sizes: each text's words."""
    place, q, need = _kept_grid(least, times)
    short = np.flatnonzero(sizes <= KEPT_WORDS)
    counts = np.searchsorted(need, sizes[short], side="right")
    ends = np.cumsum(counts)
    edges = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(CANDIDATES, int(ends[-1]) if len(ends) else 0, CANDIDATES)), [len(short)])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        many = counts[a:b]
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        text = np.repeat(short[a:b], many)
        yield text, first[text] + place[inside], q[inside]
    for text in np.flatnonzero(sizes > KEPT_WORDS).tolist():
        n, low = int(sizes[text]), 1
        while low <= n // times:
            high = min(n // times + 1, low + max(1, CANDIDATES * low // n))
            place, q, _ = _grid(n, low, high, least, times)
            yield np.full(len(q), text), first[text] + place, q
            low = high


def periodic_runs(words: np.ndarray, sizes: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """text, start (word of the text), length and period of all runs, by text, start and period. words: numbers from 0, text
    after text; sizes: words of each text."""
    offsets = np.cumsum(sizes) - sizes
    # A 0 before each text and after the last.
    first = offsets + np.arange(1, len(sizes) + 1)
    line = np.zeros(len(words) + len(sizes) + 1, np.int64)
    line[np.arange(len(words)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = words + 1
    n = len(line)
    parts = []
    rounds = mirror = None
    for text, x, q in candidates(first, sizes, least, times):
        again = np.flatnonzero(line[x] == line[x + q])
        if not len(again):
            continue
        if rounds is None:
            rounds = recompress(line, int(line.max()) + 1)
            mirror = [r.mirrored() for r in rounds]
        text, x, q = text[again], x[again], q[again]
        ahead = extensions(rounds, x, x + q)
        back = extensions(mirror, n - (x + q), n - x)
        length = q + ahead + back
        good = length >= np.maximum(least, times * q)
        parts.append(np.stack([text[good], (x - back - first[text])[good], length[good], q[good]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    text, start, length, q = np.concatenate(parts, axis=1)
    # A stretch found by several periods has the smallest as its own; the others are its multiples.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[fresh], start[fresh], length[fresh], q[fresh]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """id, n_words, runs (array of start, length, period: by start, then period) and collapsed: the text's words joined by
    a space, without those that repeat: a word goes if any run contains it after the run's first period."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = text_bytes(batch.column(1))
        starts, ends, rows = byte_words(flat, offsets, WORD_BYTES)
        sizes = np.bincount(rows, minlength=batch.num_rows)
        begin = np.cumsum(sizes) - sizes
        text, start, length, q = periodic_runs(exact_ids(flat, starts, ends), sizes, least, times)
        marks = np.zeros(len(starts) + 1, np.int64)
        np.add.at(marks, begin[text] + start + q, 1)
        np.add.at(marks, begin[text] + start + length, -1)
        kept = np.cumsum(marks[:-1]) == 0
        # Kept words and, but for a text's first, the byte before each, as a space.
        s, e, r = starts[kept], ends[kept], rows[kept]
        inner = np.ones(len(s), bool)
        inner[:1] = False
        inner[1:] = r[1:] == r[:-1]
        mask = np.zeros(len(flat) + 1, np.int8)
        mask[s] += 1
        np.add.at(mask, e, -1)
        mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
        shown = flat.copy()
        mask[s[inner] - 1], shown[s[inner] - 1] = True, 0x20
        out = shown[mask]
        lengths = np.zeros(batch.num_rows, np.int64)
        np.add.at(lengths, r, e - s + inner)
        borders = np.concatenate(([0], np.cumsum(lengths)))
        texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(out.tobytes())]).cast(pa.string())
        fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], ["start", "length", "period"])
        borders = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=batch.num_rows)))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(borders), fields), texts], ["id", "n_words", "runs", "collapsed"])

    if id_col.lower() in ("n_words", "runs", "collapsed"):
        raise ValueError(f"the id column can't be named {id_col}")
    rows = picked(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return over_texts(rows, "text", judge, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
