"""Quality rules with suffix-array repetition.

For each text a suffix array over its words is built by rank doubling (all texts of a slice at once, ranks kept
apart by text; words are numbered exactly, equal numbers mean equal bytes). Longest common prefixes of neighbours
form intervals; an interval whose suffixes don't all follow the same word is a maximal repeated substring. The spans of
those with `window` words or more are united, and rules limit the share of words that the spans cover and the longest
repeat.

Defined results: a null or empty text has no words, fails the least-words rule and is not kept; repeated rows are
judged alike; null or repeated ids are as good as any; long texts are measured whole; other columns, whatever their
names, don't matter (quality) or pass through unchanged (keep_good); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillway.llm.common import byte_words, exact_ids, over_texts, picked, placed, slices, text_bytes

WORD_BYTES = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
LINE_BYTES = np.array([b != 0x0A for b in range(256)])
SYMBOL_BYTES = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
WINDOW = 8


def suffix_ranks(words: np.ndarray, rows: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of word numbers (equal suffixes only within a row) and the ranks after each doubling: level k tells
    suffixes apart by their first 2^k words. last: end of each word's row."""
    n = len(words)
    key = rows * np.int64(words.max(initial=0) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)

    def settle(places: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Give the suffixes at `places` of the order their group's first place as rank; return those still tied."""
        first = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[order[places]] = first
        alone = fresh & np.append(fresh[1:], True)
        return places[~alone]

    places = np.arange(n)
    tied = settle(places, np.concatenate(([True], key[order][1:] != key[order][:-1]))) if n else places
    levels, length = [rank.copy()], 1
    while len(tied):
        at = order[tied]
        ahead = at + length
        second = np.where(ahead < last[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[at] * np.int64(n + 1) + second
        turn = np.argsort(pair, kind="stable")
        order[tied], pair = at[turn], pair[turn]
        tied = settle(tied, np.concatenate(([True], pair[1:] != pair[:-1])))
        length *= 2
        levels.append(rank.copy())
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], last: np.ndarray, window: int) -> np.ndarray:
    """For each place of the suffix array, the words that its suffix shares with the one before; 0 if under window."""
    n, level = len(order), window.bit_length() - 1
    out = np.zeros(n, np.int64)
    if n < 2 or level >= len(levels):
        return out
    rank = levels[level][order]
    near = np.flatnonzero(rank[1:] == rank[:-1]) + 1
    a, b = order[near], order[near - 1]
    have = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + have, b + have
        inside = (x < last[a]) & (y < last[b]) & (last[a] == last[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        have += same * (1 << k)
    out[near] = np.where(have >= window, have, 0)
    return out


def prefix_intervals(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, length) of each interval of the suffix array: the widest run of neighbours that share
    `length` words, for each length that some neighbours share just so. shared: common_prefixes."""
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []  # (first place, length), lengths ascending
    before = -2
    places = np.flatnonzero(shared)
    for place, value in zip(places.tolist(), shared[places].tolist(), strict=True):
        if place != before + 1:
            found += [(a, before, x) for a, x in open_]
            open_ = []
        first = place - 1
        while open_ and open_[-1][1] > value:
            first, x = open_.pop()
            found.append((first, before, x))
        if not open_ or open_[-1][1] < value:
            open_.append((first, value))
        before = place
    found += [(a, before, x) for a, x in open_]
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def maximal_repeats(words: np.ndarray, rows: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeated substrings of `window` words or more within rows: (row, words) of each, and (start, words) of
    places whose spans cover all that they cover."""
    order, levels = suffix_ranks(words, rows, last)
    shared = common_prefixes(order, levels, last, window)
    low, high, length = prefix_intervals(shared)
    n = len(order)
    none = np.zeros(0, np.int64)
    if not len(low):
        return none, none, none, none
    # The word before each suffix; the first of a row has none, so it differs from any.
    head = np.concatenate(([True], rows[1:] != rows[:-1]))
    before = np.where(head, np.int64(-1), np.concatenate(([0], words[:-1])))[order]
    turns = np.cumsum(np.concatenate(([0], before[1:] != before[:-1])))
    left = turns[high] > turns[low]
    # A suffix's deepest interval covers what the wider ones do; one that isn't maximal is covered from a word before.
    deepest = np.maximum(shared, np.append(shared[1:], 0))
    places = np.flatnonzero(deepest)
    kept = rows[order[low[left]]]
    return kept, length[left], order[places], deepest[places]


def measure(column: pa.Array, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The counts of each text of a column, with the united word spans of maximal repeats of `window` words or more."""
    flat, offsets = text_bytes(column)
    n_rows = len(column)
    starts, ends, rows = byte_words(flat, offsets, WORD_BYTES)
    n_words = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(n_words)))
    last = first[rows + 1]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    line_starts, line_ends, line_rows = byte_words(flat, offsets, LINE_BYTES)
    word_counts = np.concatenate(([0], np.cumsum(WORD_BYTES[flat])))
    lines = np.flatnonzero(word_counts[line_ends] > word_counts[line_starts])
    line_key = exact_ids(flat, line_starts[lines], line_ends[lines]) + line_rows[lines] * np.int64(len(lines) + 1)
    earlier = np.ones(len(lines), bool)
    earlier[np.unique(line_key, return_index=True)[1]] = False

    found_rows, found_words, at, reach = maximal_repeats(exact_ids(flat, starts, ends), rows, last, window)
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + reach, -1)
    covered = np.cumsum(step[:-1]) > 0
    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, found_rows, found_words)
    # Spans of neighbouring rows can't touch: a span ends with its row, and runs are cut where the row changes.
    edge = np.diff(rows, prepend=-1) != 0
    begin = covered & (np.concatenate(([True], ~covered[:-1])) | edge) if len(covered) else covered
    stop = covered & np.concatenate((~covered[1:] | edge[1:], [True])) if len(covered) else covered
    return {
        "n_words": n_words,
        "word_chars": total(WORD_BYTES[flat] & ((flat & 0xC0) != 0x80)),
        "n_symbols": total(SYMBOL_BYTES[flat]),
        "n_dup_lines": np.bincount(line_rows[lines][earlier], minlength=n_rows),
        "n_repeat_words": np.bincount(rows[covered], minlength=n_rows),
        "n_repeats": np.bincount(found_rows, minlength=n_rows),
        "longest_repeat": longest,
        "span_row": rows[begin],
        "span_start": np.flatnonzero(begin) - first[rows[begin]],
        "span_end": np.flatnonzero(stop) + 1 - first[rows[stop]],
    }


def verdict(found: dict[str, np.ndarray], min_words: int, max_percent: int, max_longest: int, longest_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(fails the base rules, is kept). A repeat is too long when it has over max_longest words and over
    longest_percent of the text's words."""
    n = found["n_words"]
    failed = (n < min_words) | (100 * found["n_repeat_words"] > max_percent * n)
    too_long = (found["longest_repeat"] > max_longest) & (100 * found["longest_repeat"] > longest_percent * n)
    return failed, ~failed & ~too_long


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = 20, max_percent: int = 30, max_longest: int = 100, longest_percent: int = 20) -> DataFrame:
    """id, the counts (n_repeats: distinct maximal repeats), repeat_starts and repeat_ends (word spans, arrays),
    base_failed, kept; one row per row of df."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(batch.column(1), window)
        failed, kept = verdict(found, min_words, max_percent, max_longest, longest_percent)
        places = np.concatenate(([0], np.cumsum(np.bincount(found["span_row"], minlength=batch.num_rows)))).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(places), pa.array(found[k].astype(np.int64))) for k in ("span_start", "span_end")]
        arrays = [batch.column(0), *(pa.array(found[k].astype(np.int64)) for k in COUNTS), *spans, pa.array(failed), pa.array(kept)]
        return pa.RecordBatch.from_arrays(arrays, ["id", *COUNTS, "repeat_starts", "repeat_ends", "base_failed", "kept"])

    rows = picked(df, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in COUNTS) + ", repeat_starts array<long>, repeat_ends array<long>, base_failed boolean, kept boolean"
    return over_texts(rows, "text", run, schema).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", window: int = WINDOW, min_words: int = 20, max_percent: int = 30, max_longest: int = 100, longest_percent: int = 20) -> DataFrame:
    """The rows of df, all columns, whose text is kept."""
    rows, (text,) = placed(df, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                kept = verdict(measure(part.column(text), window), min_words, max_percent, max_longest, longest_percent)[1]
                yield part.filter(pa.array(kept))

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
