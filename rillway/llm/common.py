"""Helpers shared by the training-data operators: columns by place, lineage cuts, joins that spread hot keys, and byte
views of text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.tables import cut, new_path, shared_dir

__all__ = ["byte_words", "cut", "exact_ids", "mix64", "new_path", "over_texts", "placed", "picked", "shared_dir", "slices", "spread_join", "text_bytes", "word_hashes"]

SLICE_BYTES = 1 << 19


def placed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named by place (_c0, _c1, ...), and where the named ones are: found exactly, else in other
    case. So dots in names, and extra columns whose names clash with others or with results, can't disturb."""
    found = [df.columns.index(n) if n in df.columns else [c.lower() for c in df.columns].index(n.lower()) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), [f"_c{i}" for i in found]


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns of df, under the names of the keywords."""
    held, columns = placed(df, *names.values())
    return held.select(*[F.col(c).alias(k) for k, c in zip(names, columns, strict=True)])


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", crowd: int = 500, parts: int = 64, counted: DataFrame | None = None) -> DataFrame:
    """left joined with right on key, where keys with a crowd of rows on the left are dealt over `parts` partitions and
    their rows on the right repeated there. left should be a table, as it is read twice; or its keys are counted in
    `counted`, a table that has them as often. The 10,000 most crowded keys at
    most are dealt, so that their list can be broadcast; the others are joined as they are."""
    counts = (left if counted is None else counted).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd)
    hot = F.broadcast(counts.orderBy(F.desc("_n"), key).limit(10_000).select(F.col(key).alias("_hot")))
    others = [F.col(f"`{c}`") for c in left.columns]
    a = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*others), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    b = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [key, "_part"], how).drop("_part")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the offsets of its n+1 borders; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about `limit` bytes of text each, so numpy work stays in bounded memory."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text_col))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def over_texts(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to bounded Arrow slices of df, at least one row each; fn returns a batch of `schema`."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield fn(part)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_words(flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions in flat) and row of each maximal run of word bytes; runs never cross rows."""
    mask = is_word[flat]
    n = len(flat)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:]
    borders = offsets[1:-1]
    inner = borders[(borders > 0) & (borders < n)]
    begins[inner] = mask[inner]
    stops[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: the sum of its scrambled 8-byte blocks, each keyed by its place in the range."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    view = np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,))
    blocks = np.maximum((sizes + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * inside
    left = np.minimum(np.repeat(ends, blocks) - at, 8)
    keyed = mix64((view[at] & _MASKS[left]) ^ mix64(inside + 1))
    return mix64(np.add.reduceat(keyed, first) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def exact_ids(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte range, the same exactly for equal bytes: ranges of equal hash are compared byte by byte."""
    _, first, ids = np.unique(word_hashes(flat, starts, ends), return_index=True, return_inverse=True)
    again = np.flatnonzero(first[ids] != np.arange(len(ids)))
    other, sizes = first[ids[again]], (ends - starts)
    same = bool((sizes[again] == sizes[other]).all())
    total = np.cumsum(sizes[again])
    steps = np.arange(SLICE_BYTES, int(total[-1]) if len(total) else 0, SLICE_BYTES)
    edges = np.unique(np.concatenate(([0], np.searchsorted(total, steps), [len(again)])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if not same:
            break
        part, length = again[a:b], sizes[again[a:b]]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        same = np.array_equal(flat[np.repeat(starts[part], length) + inside], flat[np.repeat(starts[other[a:b]], length) + inside])
    if not same:
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(flat[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], np.int64)
    return ids
