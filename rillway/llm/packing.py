"""Hierarchical multi-length packing of token sequences.

Documents are encoded by a tokenizer file of the tokenizers library and end with an id. Their whole windows of the longest
context size are sequences; what is left of each is routed to the smallest tier (a context size, a power of two) that holds
it. From the longest tier down, each window takes the longest piece of its tier, its gap is filled with the pieces of
shorter tiers that fit best, and what still lacks is cut from the longest shorter piece (from its own tier where there is
none), whose rest is routed anew. So all windows are full; what the last of a block lacks is avoided by splitting its
content into powers of two. Sequences are dealt to step groups of about `step_tokens` tokens, the longest and costliest first,
each to the group with the fewest tokens and then the least attention cost (sum of squared piece lengths).

Blocks of about BLOCK_IDS ids of one partition are packed at once, in a task, without a shuffle: a lost task packs its rows
again in the same way, if its input comes in the same order (a file's or a table's rows do).

Defined results: a null or empty text is its end id alone; null and repeated ids and repeated rows are as good as any, each
row is a document of its own; long texts are encoded whole and cut freely; columns beside the id and the text are ignored,
whatever their names, and an id named like a result is a ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillway.llm.common import exact_ids, picked, slices, text_bytes

#: Context sizes, and the tokens of a step.
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 17
#: Ids packed at once, bytes of text encoded at once, and pieces whose ids a worker keeps at most.
BLOCK_IDS, SLICE, KEPT_PIECES = 1 << 21, 1 << 21, 800_000
LETTER, NUMBER, SPACE = 1, 2, 3
APOSTROPHE, BLANK = ord("'"), ord(" ")


def character_classes(split: Callable[[str], list[str]]) -> np.ndarray:
    """Letter, number, white space or else 0, for each code point, as the tokenizer's own `split` has them: the code points
    in order fall into stretches of one class, and one of each is tried after a letter, a number and a mark."""
    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for piece in split("".join(map(chr, range(low, high)))):
            c = piece[-1]
            kind = next((k for k, before in ((LETTER, "A"), (NUMBER, "1"), (0, "!")) if len(split(before + c)) == 1), SPACE)
            out[ord(piece[0]) : ord(c) + 1] = kind
    out[BLANK] = SPACE  # it goes with what follows
    return out


def piece_starts(flat: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where the pieces begin into which byte-level tokenizers split texts: contractions (`'s 't 're 've 'm
    'll 'd`), letters, numbers or others, each with the blank before it, and white space, of which the last character before
    something else stands apart."""
    if not len(flat):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((flat & 0xC0) != 0x80)
    points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes[points]
    head = np.zeros(len(points) + 4, bool)
    head[np.searchsorted(at, offsets[:-1])] = True
    head = head[: len(points)]
    head[0] = True
    begins = head.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begins & ~head & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    starts = begins.copy()
    starts[after - 1] = True
    starts[after[points[after - 1] == BLANK]] = False
    # Contractions: an apostrophe that begins a piece, then certain letters of the same text.
    quotes = np.flatnonzero(starts & (points == APOSTROPHE))
    line = np.concatenate((points, np.zeros(2, np.uint32)))
    border = np.concatenate((head, np.ones(2, bool)))
    one, two = line[quotes + 1], line[quotes + 2]
    inside = ~border[quotes + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside & ~border[quotes + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    size = 1 + short + 2 * long
    cut = quotes[size > 1]
    starts[cut + 1] = False
    ends = cut + size[size > 1]
    ends = ends[ends < len(points)]
    # A blank after a contraction is a piece's begin already; a letter in its midst becomes one.
    starts[ends[kind[ends] == LETTER]] = True
    return at[starts]


class PieceIds:
    """Ids of texts by a tokenizer file: each distinct piece goes through the library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        split = self.library.pre_tokenizer.pre_tokenize_str
        self.classes = character_classes(lambda text: [text[a:b] for _, (a, b) in split(text)])
        self.known: dict[bytes, int] = {}
        self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        coded = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.counts = np.append(self.counts, [len(x) for x in coded])
        self.pool = np.append(self.pool, np.fromiter(itertools.chain.from_iterable(coded), np.uint32))

    def ids(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each text has."""
        starts = piece_starts(flat, offsets, self.classes)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(flat))
        numbers = exact_ids(flat, starts, ends)
        first = np.zeros(int(numbers.max()) + 1, np.int64)
        first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
        held = flat.tobytes()
        pieces = [held[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        kept = len(self.known), len(self.pool)
        if fresh := [p for p in pieces if p not in self.known]:
            self._learn(fresh)
        place = np.array([self.known[p] for p in pieces])
        at = np.concatenate(([0], np.cumsum(self.counts)))[place]
        many = self.counts[place][numbers]
        begin = np.cumsum(many)
        total = int(begin[-1])
        ids = self.pool[np.repeat(at[numbers] - (begin - many), many) + np.arange(total)]
        borders = np.concatenate(([0], begin))[np.searchsorted(starts, offsets)]
        if len(self.known) > KEPT_PIECES:  # what came first is most frequent; the rest isn't kept
            for p in fresh:
                del self.known[p]
            self.counts, self.pool = self.counts[: kept[0]], self.pool[: kept[1]]
        return ids, np.diff(borders)


@functools.cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


class Packer:
    """Sequences from the lengths of documents: `rows` of (document, start, length, sequence, offset), `windows` and `costs`
    by sequence."""

    def __init__(self, lengths: list[int], tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.windows: list[int] = []
        #: Pieces by tier, each list ascending: (length, document, start).
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        top = self.tiers[-1]
        for doc, n in enumerate(lengths):
            for start in range(0, n - top + 1, top):
                self._emit([(top, doc, start)], top)
            if n % top:
                self.pools[bisect.bisect_left(self.tiers, n % top)].append((n % top, doc, n - n % top))
        for pool in self.pools:
            pool.sort()
        for level in range(len(self.tiers) - 1, -1, -1):
            while self.pools[level]:
                self._window(level)

    def _emit(self, parts: list[tuple[int, int, int]], window: int) -> None:
        sequence, offset = len(self.windows), 0
        for n, doc, start in parts:
            self.rows.append((doc, start, n, sequence, offset))
            offset += n
        self.windows.append(window)

    def _route(self, piece: tuple[int, int, int]) -> None:
        bisect.insort(self.pools[bisect.bisect_left(self.tiers, piece[0])], piece)

    def _fitting(self, level: int, gap: int) -> tuple[int, int, int] | None:
        """The longest piece of the tiers up to `level` that is not longer than the gap."""
        for pool in reversed(self.pools[: level + 1]):
            i = bisect.bisect_left(pool, (gap + 1,))
            if i:
                return pool.pop(i - 1)
        return None

    def _window(self, level: int) -> None:
        size = self.tiers[level]
        parts = [self.pools[level].pop()]
        gap = size - parts[0][0]
        while gap:
            # Pieces of the window's own tier fit only in the lowest.
            piece = self._fitting(level if level == 0 else level - 1, gap)
            if piece is None:
                pool = next((p for p in (*reversed(self.pools[:level]), self.pools[level]) if p), None)
                if pool is None:
                    break
                n, doc, start = pool.pop()
                piece = (min(n, gap), doc, start)
                if n > gap:
                    self._route((n - gap, doc, start + gap))
            parts.append(piece)
            gap -= piece[0]
        if not gap:
            self._emit(parts, size)
            return
        # Nothing is left to fill the last window with: its content makes windows of powers of two.
        whole = size - gap
        for window in (1 << k for k in range(whole.bit_length() - 1, -1, -1) if whole >> k & 1):
            own, left = [], window
            while left:
                n, doc, start = parts.pop(0)
                if n > left:
                    parts.insert(0, (n - left, doc, start + left))
                own.append((min(n, left), doc, start))
                left -= own[-1][0]
            self._emit(own, window)

    def steps(self, step_tokens: int) -> list[int]:
        """A step group for each sequence: of about equal tokens and, for equal tokens, attention cost."""
        cost = [0] * len(self.windows)
        for _, _, n, sequence, _ in self.rows:
            cost[sequence] += n * n
        groups = [(0, 0, g) for g in range(max(1, round(sum(self.windows) / step_tokens)))]
        out = [0] * len(self.windows)
        for s in sorted(range(len(self.windows)), key=lambda s: (-self.windows[s], -cost[s], s)):
            tokens, work, g = groups[0]
            heapq.heapreplace(groups, (tokens + self.windows[s], work + cost[s], g))
            out[s] = g
        return out


COLUMNS = "start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_id long, ids binary"


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece of a document: id, start (ids before it in the document), length, doc_tokens, sequence_id and
    offset (where it lies), window (ids of the sequence), step_id (the step group) and ids (little-endian unsigned 32-bit)."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches):
        coder, part = piece_ids(tokenizer_path), TaskContext.get().partitionId() << 33
        keys, arrays, counts, held, sequences, groups = [], [], [], 0, 0, 0

        def packed():
            nonlocal sequences, groups
            ids, lengths = np.concatenate(arrays), np.concatenate(counts)
            made = Packer(lengths.tolist(), tiers)
            step = np.array(made.steps(step_tokens), np.int64)
            doc, start, length, sequence, offset = np.array(made.rows, np.int64).T
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            key = pa.concat_arrays(keys).take(pa.array(doc))
            window = np.array(made.windows, np.int64)[sequence]
            columns = [start, length, lengths[doc], part + sequences + sequence, offset, window, part + groups + step[sequence]]
            ends = np.concatenate(([0], np.cumsum(length)))
            raw = ids[np.repeat(begin - ends[:-1], length) + np.arange(int(ends[-1]))]
            # Batches of about 4 MB of ids.
            edges = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(SLICE // 2, int(ends[-1]), SLICE // 2)), [len(doc)])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                borders = (4 * (ends[a : b + 1] - ends[a])).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(borders), pa.py_buffer(raw[ends[a] : ends[b]].astype("<u4"))])
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), *[pa.array(c[a:b]) for c in columns], data], names)
            sequences, groups = sequences + len(made.windows), groups + int(step.max()) + 1
            keys.clear(), arrays.clear(), counts.clear()

        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                flat, offsets = text_bytes(rows.column(1))
                ids, many = coder.ids(flat, offsets)
                # The end id after each text's own.
                arrays.append(np.insert(ids, np.cumsum(many), end_id).astype(np.uint32))
                counts.append(many + 1)
                keys.append(rows.column(0))
                held += len(ids) + len(many)
                if held >= BLOCK_IDS:
                    yield from packed()
                    held = 0
        if keys:
            yield from packed()

    rows = picked(df, id=id_col, text=text_col)
    names = ["id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    if id_col.lower() in names[1:]:
        raise ValueError(f"the id column can't be named {id_col}")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}").withColumnRenamed("id", id_col)
