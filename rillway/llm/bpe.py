"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the tokenizer's pattern, each distinct piece goes through the library once, and its ids are
kept as little-endian bytes, so a document's ids are one join. Decoding reverses the byte-to-character table; a
character split over several tokens comes back whole because bytes, not strings, are joined.

Defined results: a null or empty text has no ids and decodes to no bytes; long texts are encoded whole; null ids are as
good as any; repeated rows give repeated results; columns other than the id and the text are ignored, whatever their
names, and the id may bear a result's name only if that result isn't asked for (else a ValueError); an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import over_texts, picked, placed

#: Pieces whose ids a worker keeps at most; beyond it the store starts anew (speed only, never results).
KEPT_PIECES = 250_000


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes `token`: what merges of lower rank leave of it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, own) for a, b in itertools.pairwise(parts)]
        at = min(range(len(joined)), key=joined.__getitem__)
        if joined[at] >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], b"".join(parts[1:]))


class PieceCoder:
    """Ids of texts for one rank file and pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [tuple(name[x] for x in merge_pair(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(x) for x in texts]
        new = list(set(itertools.chain.from_iterable(split)) - self.kept.keys())
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept = {}
            new = list(set(itertools.chain.from_iterable(split)))
        for piece, coded in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.kept[piece] = struct.pack(f"<{len(coded)}I", *coded.ids)
        return [b"".join(map(self.kept.__getitem__, pieces)) for pieces in split]


class TokenBytes:
    """Bytes of ids, from the characters that stand for bytes in each token's name."""

    def __init__(self, ranks_path: str):
        shown = byte_characters()
        back = {c: b for b, c in enumerate(shown)}
        named = {i: "".join(shown[b] for b in token) for token, i in read_ranks(ranks_path).items()}
        self.token_bytes = [bytes(back[c] for c in named.get(i, "")) for i in range(max(named) + 1)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token; tokens inside one character share it."""
        tokens = [self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        character = np.cumsum((flat & 0xC0) != 0x80)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return character[starts] - 1 if len(ends) else ends, character[ends - 1] if len(ends) else ends


@functools.cache
def token_table(ranks_path: str) -> TokenBytes:
    return TokenBytes(ranks_path)


@functools.cache
def coder(ranks_path: str, pattern: str) -> PieceCoder:
    return PieceCoder(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """id, n_tokens and ids (binary, little-endian unsigned 32-bit), one row per row of df.

    offsets=True adds starts and ends: arrays of code point positions of each token in its text. decoded=True adds
    decoded (binary), what the ids decode to, without another trip of the ids through the JVM.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(ranks_path, pattern)
        ids = own.ids(batch.column(1).fill_null("").to_pylist())
        arrays = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        names = ["id", "n_tokens", "ids"]
        if offsets:
            spans = [token_table(ranks_path).offsets(x) for x in ids]
            arrays += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            names += ["starts", "ends"]
        if decoded:
            arrays.append(pa.array([token_table(ranks_path).decode(x) for x in ids], pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(arrays, names)

    rows = picked(df, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary" + ", starts array<long>, ends array<long>" * offsets + ", decoded binary" * decoded
    coded = over_texts(rows, "text", run, schema)
    if id_col.lower() in [c.lower() for c in coded.columns[1:]]:
        raise ValueError(f"the id column can't be named {id_col}")
    return coded.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `carry`, and decoded (binary): the bytes that the ids stand for; null ids decode to none."""

    names = (id_col, *carry)
    held, found = placed(df, *names, ids_col)
    rows = held.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(found)])
    last = f"_{len(names)}"

    def run(batches):
        for batch in batches:
            own = token_table(ranks_path)
            out = [own.decode(x or b"") for x in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1])
    return rows.mapInArrow(run, f"{kinds}, decoded binary").toDF(*names, "decoded")
