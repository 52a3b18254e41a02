"""Exact substring dedup: bytes inside a `length`-byte string that starts earlier in the corpus are removed.

Each window of `length` bytes has an anchor: its k-byte string of least hash, leftmost among equals. Equal windows
have equal anchors at equal offsets, so windows with the same anchor, a run called a segment here, are compared only
with segments of that anchor. Texts lie in chunks (by hash of id and text) that are shuffled once and read three times:

1. each chunk tells its distinct anchors to buckets, which answer those that another chunk has too;
2. each chunk sends its distinct segments with such anchors, whose suffixes from the anchor (and, reversed, before
   it) are sorted by deep-shallow sorting: multikey quicksort on 8-byte characters to a shallow depth, then blind
   tries for groups that still share a prefix; longest common prefixes of neighbours tell which windows are equal;
3. each chunk marks what is not the earliest of its class, unites the marks and cuts the bytes.

An anchor with more than `hot` distinct segments has its windows sent one by one, by content and by a share of the
chunks of about `hot` segments: a bucket first finds the earliest of its share, and only those meet in a second round. So
no bucket gathers an unbounded group, even for a passage that every document has. Copies within a chunk are settled there
and sent once.

Defined results: a null or empty text has no bytes; ids are whole numbers (else a TypeError), null ids come first; rows
with equal ids are ordered by the text's hash, then the text, so of repeated rows the first stays; long texts are taken
whole; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.common import exact_ids, mix64, picked, text_bytes, word_hashes

ANCHOR = 24
BLOCK = 1 << 22
SHALLOW_WORDS = 5
_NULL_ID = np.iinfo(np.int64).min
_BYTE = mix64(np.arange(7001, 7257, dtype=np.uint64))
_M = np.uint64(0x9FB21C651E98DF25)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two strings laid end to end from their hashes."""
    out = a * _M
    out += b
    out ^= out >> np.uint64(29)
    out *= _M
    return out


def anchor_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each position (16 + 8, by doubling)."""
    h = _BYTE[flat]
    for step in (1, 2, 4):
        h = _join(h[:-step], h[step:])
    sixteen = _join(h[:-8], h[8:])
    out = _join(sixteen[:-8], h[16:])
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Segments:
    """The segments of a chunk, by position: anchor (hash), start (of the first window), windows, before (bytes from
    start to the anchor), row."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, length: int):
        self.flat, self.offsets, self.length = flat, offsets, length
        parts = [self._block(b) for b in range(0, max(len(flat) - length + 1, 0), BLOCK)]
        self.anchor, self.start, self.windows, self.before = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64)))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        # Copies of earlier segments of the chunk; they share their anchor.
        self.earlier = np.zeros(len(self.start), bool)
        _, place, counts = np.unique(self.anchor, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[place] > 1)
        own = exact_ids(flat, self.start[again], self.start[again] + self.windows[again] + length - 1)
        self.earlier[again] = True
        self.earlier[again[np.unique(own, return_index=True)[1]]] = False

    def _block(self, begin: int) -> tuple[np.ndarray, ...]:
        part = self.flat[begin : begin + BLOCK + self.length - 1]
        hashes = anchor_hashes(part)
        low = np.uint64((1 << 24) - 1)
        key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(key, self.length - ANCHOR + 1)
        n = len(least)
        valid = np.ones(n + self.length, bool)
        for a, b in zip(self.offsets[:-1] - begin, self.offsets[1:] - begin, strict=True):
            if b > 0 and a < n:
                valid[max(a, b - self.length + 1, 0) : max(b, 0)] = False
        valid = valid[:n]
        fresh = valid.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        start = np.flatnonzero(fresh)
        border = np.append(np.flatnonzero(fresh | ~valid), n)
        windows = border[np.searchsorted(border, start, side="right")] - start
        at = (least[start] & low).astype(np.int64)
        return hashes[at], start + begin, windows, at - start


def _chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk's rows in the corpus's order, their bytes and borders."""
    table = table.sort_by([(c, "ascending") for c in ("id", "digest", "text")]) if table.num_rows > 1 else table
    nulls = table.column("id").null_count
    if nulls:
        table = pa.concat_tables([table.slice(table.num_rows - nulls), table.slice(0, table.num_rows - nulls)])
    flat, offsets = text_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return table, flat, offsets


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _split(owner: np.ndarray, n: int, arrays: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The values of each owner that has any, as bytes."""
    order = np.argsort(owner, kind="stable")
    found, first = np.unique(owner[order], return_index=True)
    edges = np.append(first, len(order))
    return found, [[a[order[edges[i] : edges[i + 1]]].tobytes() for i in range(len(found))] for a in arrays]


# The rows that travel: items of one chunk for one bucket, their fields laid end to end.
ANCHORS = "bucket int, chunk int, anchors binary, counts binary"
ANSWERS = "chunk int, anchors binary, parts binary"
FIELDS = {"segment": np.int32, "id": np.int64, "digest": np.int64, "row": np.int32, "start": np.int32, "before": np.int32, "windows": np.int32, "again": np.uint8, "size": np.int32}
SENT = "bucket int, chunk int, " + ", ".join(f"{f} binary" for f in FIELDS) + ", data binary"
#: What a bucket tells: marks, and (where `first` is null) windows for the second round, which passes marks on.
MARKS = SENT + ", first binary, count binary"
_NAMES = [x.split()[0] for x in MARKS.split(", ")]


def _sent(bucket: np.ndarray, chunk: np.ndarray, fields: dict[str, np.ndarray], flat: np.ndarray, begin: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """Items as rows by bucket and chunk; begin: where each item's `size` bytes are in flat."""
    owner = bucket.astype(np.int64) * (1 << 32) + chunk
    found, columns = _split(owner, 0, [fields[f].astype(t) for f, t in FIELDS.items()])
    order, size = np.argsort(owner, kind="stable"), fields["size"]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
    data = flat[np.repeat(begin[order], size[order]) + inside].tobytes()
    ends = np.cumsum([int(np.frombuffer(x, np.int32).sum()) for x in columns[-1]]).astype(np.int64)
    blobs = [data[(ends[i - 1] if i else 0) : ends[i]] for i in range(len(found))]
    out = {"bucket": pa.array((found >> 32).astype(np.int32)), "chunk": pa.array((found & 0xFFFFFFFF).astype(np.int32))}
    return out | {f: pa.array(c, pa.binary()) for f, c in zip(FIELDS, columns, strict=True)} | {"data": pa.array(blobs, pa.binary())}


def anchors_of(table: pa.Table, length: int, buckets: int) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    _, flat, offsets = _chunk(table)
    segs = Segments(flat, offsets, length)
    anchors, counts = np.unique(segs.anchor[~segs.earlier], return_counts=True)
    found, (a, c) = _split((anchors % np.uint64(buckets)).astype(np.int64), buckets, [anchors, counts.astype(np.uint32)])
    return pa.table({"bucket": pa.array(found.astype(np.int32)), "chunk": pa.array([chunk] * len(found), pa.int32()), "anchors": pa.array(a, pa.binary()), "counts": pa.array(c, pa.binary())})


def answers_of(table: pa.Table, hot: int) -> pa.Table:
    """For each chunk, its anchors that another chunk has too, and the parts that a hot one's windows are dealt over."""
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) // 8 for x in table.column("anchors").to_pylist()])
    anchors, counts = _numbers(table.column("anchors"), np.uint64), _numbers(table.column("counts"), np.uint32)
    order = np.argsort(anchors, kind="stable")
    fresh = np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])) if len(order) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weights=counts[order].astype(float))
    shared = order[np.bincount(group)[group] > 1] if len(order) else order
    parts = np.zeros(len(anchors), np.uint32)
    parts[order] = np.where(total > hot, np.ceil(total / hot), 0)[group] if len(order) else 0
    found, (a, p) = _split(chunk[shared], 0, [anchors[shared], parts[shared]])
    return pa.table({"chunk": pa.array(found.astype(np.int32), pa.int32()), "anchors": pa.array(a, pa.binary()), "parts": pa.array(p, pa.binary())})


def segments_of(table: pa.Table, answers: pa.Table, length: int, buckets: int, hot: int) -> pa.Table:
    if not table.num_rows:
        return pa.table({n: pa.array([], pa.int32() if n in ("bucket", "chunk") else pa.binary()) for n in _NAMES[:-2]})
    chunk = table.column("chunk")[0].as_py()
    table, flat, offsets = _chunk(table)
    segs = Segments(flat, offsets, length)
    shared, parts = _numbers(answers.column("anchors"), np.uint64), _numbers(answers.column("parts"), np.uint32).astype(np.int64)
    own = np.flatnonzero(~segs.earlier)
    values, counts = np.unique(segs.anchor[own], return_counts=True)
    known, at = np.unique(np.concatenate((shared, values[counts > 1])), return_index=True)
    dealt = np.concatenate((parts, np.where(counts[counts > 1] > hot, 1, 0)))[at]
    place = np.minimum(np.searchsorted(known, segs.anchor[own]), max(len(known) - 1, 0))
    sends = known[place] == segs.anchor[own] if len(known) else np.zeros(len(own), bool)
    send, part = own[sends], dealt[place[sends]] if len(known) else np.zeros(0, np.int64)
    # Windows of hot anchors travel one by one, under the hash of their content and a share of the chunks.
    base, whole = send[part > 0], send[part == 0]
    each, share = np.repeat(base, segs.windows[base]), np.repeat(part[part > 0], segs.windows[base])
    j = np.arange(len(each)) - np.repeat(np.cumsum(segs.windows[base]) - segs.windows[base], segs.windows[base])
    single = word_hashes(flat, segs.start[each] + j, segs.start[each] + j + length)
    single = np.where(share > 1, mix64(single + (chunk % np.maximum(share, 1)).astype(np.uint64)), single)
    segment = np.concatenate((whole, each))
    start = np.concatenate((segs.start[whole], segs.start[each] + j))
    windows = np.concatenate((segs.windows[whole], np.ones(len(each), np.int64)))
    bucket = np.concatenate((segs.anchor[whole], single)) % np.uint64(buckets)
    row = segs.row[segment]
    fields = {
        "segment": segment, "id": table.column("id").fill_null(_NULL_ID).to_numpy()[row], "digest": table.column("digest").to_numpy()[row], "row": row, "start": start - offsets[row],
        "before": np.concatenate((segs.before[whole], segs.before[each] - j)), "windows": windows, "again": np.concatenate((np.zeros(len(whole), np.int64), share > 1)), "size": windows + length - 1,
    }
    return pa.table(_sent(bucket, np.full(len(bucket), chunk), fields, flat, start, buckets))


def blind_order(keys: list[int], bits: int) -> list[int]:
    """Indices of keys in ascending order, by a blind trie: a node knows only the bit at which its sides differ; a new
    key runs down blindly to a leaf, is compared with that leaf's key once, and enters where their first bit differs."""
    where: list[int] = []
    left: list[int] = []
    right: list[int] = []
    leaves: list[list[int]] = [[0]]
    root = -1  # leaf i is -1 - i
    for i in range(1, len(keys)):
        x, node = keys[i], root
        while node >= 0:
            node = right[node] if x >> where[node] & 1 else left[node]
        differ = x ^ keys[leaves[-1 - node][0]]
        if not differ:
            leaves[-1 - node].append(i)
            continue
        bit, node, parent = differ.bit_length() - 1, root, -1
        while node >= 0 and where[node] > bit:
            parent, node = node, right[node] if x >> where[node] & 1 else left[node]
        leaf = -1 - len(leaves)
        leaves.append([i])
        high = x >> bit & 1
        where.append(bit)
        left.append(node if high else leaf)
        right.append(leaf if high else node)
        if parent < 0:
            root = len(where) - 1
        elif x >> where[parent] & 1:
            right[parent] = len(where) - 1
        else:
            left[parent] = len(where) - 1
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node < 0:
            out += leaves[-1 - node]
        else:
            stack += (right[node], left[node])
    return out


def multikey_quicksort(words: np.ndarray, order: np.ndarray, first: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Sort `order` within its segments by rows of words (characters), in place; return the places still tied at the end.

    Each segment is split in three by a pivot (the median of three of its words at the segment's depth); the middle part
    goes one word deeper. All segments make their round together. first: for each place, its segment's first; tied: the
    places of segments with two rows or more, which lie one after the other.
    """
    depth = np.zeros(len(order), np.int64)
    deep = [np.zeros(0, np.int64)]
    while len(tied):
        value = words[order[tied], depth[tied]]
        begin = np.flatnonzero(np.concatenate(([True], first[tied][1:] != first[tied][:-1])))
        size = np.diff(np.append(begin, len(tied)))
        segment = np.repeat(np.arange(len(begin)), size)
        a, b, c = value[begin], value[begin + size // 2], value[begin + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        part = (value >= pivot).astype(np.int64) + (value > pivot)
        counts = np.bincount(3 * segment + part, minlength=3 * len(begin)).reshape(-1, 3)
        starts = begin[:, None] + np.cumsum(counts, axis=1) - counts
        place = np.empty(len(tied), np.int64)
        for k in range(3):
            mine = np.flatnonzero(part == k)
            owner = segment[mine]
            place[mine] = starts[owner, k] + np.arange(len(mine)) - (np.cumsum(counts[:, k]) - counts[:, k])[owner]
        moved, level, head = np.empty_like(tied), np.empty_like(tied), np.empty_like(tied)
        moved[place], level[place], head[place] = order[tied], depth[tied] + (part == 1), tied[starts[segment, part]]
        order[tied], depth[tied], first[tied] = moved, level, head
        fresh = np.concatenate(([True], head[1:] != head[:-1]))
        alone = fresh & np.append(fresh[1:], True)
        ended = level >= words.shape[1]
        deep.append(tied[~alone & ended])
        tied = tied[~alone & ~ended]
    return np.sort(np.concatenate(deep))


def deep_shallow_order(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """Order of byte rows (width a multiple of 8) by group, then content."""
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    fresh = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    tied = np.flatnonzero(np.bincount(first, minlength=len(order))[first] > 1)
    tied = multikey_quicksort(rows.view(">u8")[:, :shallow].astype(np.uint64), order, first, tied)
    if len(tied) and rows.shape[1] > 8 * shallow:
        tail = np.ascontiguousarray(rows[order[tied], 8 * shallow :])
        width = tail.shape[1]
        raw = tail.tobytes()
        edges = np.append(np.flatnonzero(np.concatenate(([True], first[tied][1:] != first[tied][:-1]))), len(tied)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            keys = [int.from_bytes(raw[i * width : (i + 1) * width], "big") for i in range(a, b)]
            if b - a == 2:
                turn = [0, 1] if keys[0] <= keys[1] else [1, 0]
            else:
                turn = blind_order(keys, 8 * width)
            order[tied[a:b]] = order[tied[a:b]][turn]
    return order


def shared_prefixes(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row, in order, with the one before; -1 where the group changes."""
    out = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 1 << 14):
        x, y = order[a : a + (1 << 14)], order[a - 1 : a - 1 + (1 << 14)][: len(order[a : a + (1 << 14)])]
        differ = rows[x] != rows[y]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[a : a + len(x)] = np.where(group[x] == group[y], np.minimum(at, np.minimum(sizes[x], sizes[y])), -1)
    return out


def _matrix(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of bytes from `at`, step by step, padded, with the size as last byte: of rows alike when padded the shorter
    comes first."""
    out = np.zeros((len(at), width), np.uint8)
    col = np.arange(width - 1)
    for a in range(0, len(at), 1 << 14):
        part = slice(a, a + (1 << 14))
        inside = col < sizes[part, None]
        place = np.where(inside, at[part, None] + step * col, 0)
        out[part, :-1] = data[place] * inside
    out[:, -1] = sizes
    return out


def marks_of(table: pa.Table, length: int, buckets: int, last: bool) -> pa.Table:
    """Of a bucket's segments, the windows that are not the earliest of their content, as runs by chunk and segment; in
    the first round also the windows of hot anchors that are the earliest here, in the last one the first round's marks."""
    known = table.filter(pa.compute.is_valid(table.column("first"))) if last else table.slice(0, 0)
    table = table.filter(pa.compute.is_null(table.column("first"))) if last else table
    item = {f: _numbers(table.column(f), t).astype(np.int64) for f, t in FIELDS.items()}
    item["chunk"] = np.repeat(table.column("chunk").to_numpy(), [len(x) // 4 for x in table.column("segment").to_pylist()])
    data = _numbers(table.column("data"), np.uint8)
    item["begin"] = np.cumsum(item["size"]) - item["size"]
    place = np.lexsort([item[k] for k in ("start", "row", "chunk", "digest", "id")])
    item = {k: v[place] for k, v in item.items()}
    segment, start, before, windows, size, chunk, begin = (item[k] for k in ("segment", "start", "before", "windows", "size", "chunk", "begin"))
    n, width = len(segment), -(-(length + 1) // 8) * 8
    anchor = begin + before
    after = np.minimum(begin + size - anchor, length)
    none = np.zeros(n, np.int64)
    right = _matrix(data, anchor, after, 1, width)
    right_order = deep_shallow_order(right, none)
    right_shared = shared_prefixes(right, after, right_order, none)
    del right
    group = np.empty(n, np.int64)
    group[right_order] = np.cumsum(right_shared < ANCHOR)
    left = _matrix(data, anchor - 1, before, -1, width)
    left_order = deep_shallow_order(left, group)
    left_shared = shared_prefixes(left, before, left_order, group)
    del left
    left_place, right_place = np.empty(n, np.int64), np.empty(n, np.int64)
    left_place[left_order], right_place[right_order] = np.arange(n), np.arange(n)
    left_shared, right_shared = np.maximum(left_shared, -1), np.maximum(right_shared, -1)
    marked: list[np.ndarray] = []
    spots = np.arange(n)
    for t in range(length - ANCHOR + 1):  # windows with t bytes before their anchor
        have = np.flatnonzero((before >= t) & (t > before - windows))
        if len(have) < 2:
            continue
        lead = np.maximum.accumulate(np.where(left_shared < max(t, 0), spots, 0)) if t else np.maximum.accumulate(np.where(left_shared < 0, spots, 0))
        trail = np.maximum.accumulate(np.where(right_shared < length - t, spots, 0))
        pair = lead[left_place[have]] * np.int64(n) + trail[right_place[have]]
        turn = np.argsort(pair, kind="stable")
        again = have[turn][1:][pair[turn][1:] == pair[turn][:-1]]
        marked.append(again * np.int64(1 << 32) + (before[again] - t))
    found = np.sort(np.concatenate(marked)) if marked else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], np.diff(found) != 1)) if len(found) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    count = np.diff(np.append(heads, len(found)))
    who, first = found[heads] >> 32, found[heads] & 0xFFFFFFFF
    # A window sent alone has its place in the chunk's segment, not in what was sent.
    chunks, (s, f, c) = _split(chunk[who], 0, [segment[who].astype(np.int32), (start[who] + first).astype(np.int32), count.astype(np.int32)])
    marks = {"bucket": pa.array((chunks % buckets).astype(np.int32), pa.int32()), "chunk": pa.array(chunks.astype(np.int32), pa.int32()), "segment": pa.array(s, pa.binary()), "first": pa.array(f, pa.binary()), "count": pa.array(c, pa.binary())}
    still = item["again"] > 0
    still[who] = False
    on = np.flatnonzero(still) if not last else np.zeros(0, np.int64)
    bucket = word_hashes(data, begin[on], begin[on] + length) % np.uint64(buckets)
    onward = _sent(bucket, chunk[on], {f: item[f][on] for f in FIELDS}, data, begin[on], buckets)
    kinds = {n: pa.int32() if n in ("bucket", "chunk") else pa.binary() for n in _NAMES}
    rows = [pa.table({n: x[n].cast(k) if n in x else pa.nulls(len(x["chunk"]), k) for n, k in kinds.items()}) for x in (marks, onward)]
    return pa.concat_tables([*rows, known] if last else rows)


def cut_of(table: pa.Table, marks: pa.Table, length: int, kind: pa.DataType) -> pa.Table:
    """The chunk's texts without the marked windows' bytes."""
    table, flat, offsets = _chunk(table)
    segs = Segments(flat, offsets, length)
    segment, first, count = (_numbers(marks.column(c), np.int32).astype(np.int64) for c in ("segment", "first", "count"))
    begin = np.concatenate((segs.start[segs.earlier], first + offsets[segs.row[segment]]))
    end = begin + np.concatenate((segs.windows[segs.earlier], count)) + length - 1
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    gone = np.cumsum(step[:-1]) > 0
    out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        mask = gone[a:b]
        n = int(mask.sum())
        out["n_bytes"].append(int(b - a))
        out["n_removed"].append(n)
        out["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
        out["kept"].append(flat[a:b][~mask].tobytes() if n else flat[a:b].tobytes())
    return pa.table({"id": table.column("id").cast(kind), **{k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()}})


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk_bytes: int = 1 << 20, bucket_bytes: int = 16 << 20, hot: int = 20_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay); one row per row of df.

    Memory of a task follows chunk_bytes and bucket_bytes (of text), not the corpus.
    """
    rows = picked(df, id=id_col, text=text_col)
    if not isinstance(rows.schema["id"].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integral type, as ids order the corpus")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(64, -(-total // bucket_bytes))
    texts = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), "text")
    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(lambda t: anchors_of(t, length, buckets), ANCHORS)
    answers = anchors.groupBy("bucket").applyInArrow(lambda t: answers_of(t, hot), ANSWERS)
    sent = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: segments_of(t, a, length, buckets, hot), SENT)
    once = sent.groupBy("bucket").applyInArrow(lambda t: marks_of(t, length, buckets, False), MARKS)
    marks = once.groupBy("bucket").applyInArrow(lambda t: marks_of(t, length, buckets, True), MARKS).select("chunk", "segment", "first", "count")
    done = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(lambda t, m: cut_of(t, m, length, pa.int64()), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("id", F.col("id").cast(rows.schema["id"].dataType)).withColumnRenamed("id", id_col)
