"""Secret scans with a randomness test battery.

Fixed patterns find assigned values, access keys and long hex runs. Every other token of TOKEN_LENGTH or more
characters is put to a battery for its inferred encoding (the narrowest alphabet with all its characters): chi-squared
uniformity over the alphabet, a runs test and serial correlation, combined on the logit scale (uniformity weighs twice)
into one p-value of randomness. False discoveries are controlled over all tokens of the corpus by Benjamini and
Hochberg's step-up rule within strata of token length, in both directions: over the battery's combined p-values, which
finds the tokens that aren't random, and over the p-values of "ordinary text", the inverse likelihood ratio of the
encoding's uniform letters against the corpus's own letter shares (counted over the short words of all documents).
Tokens that the first keeps as random and the second rejects as text are spans of kind `random`.

Defined results: a null or empty text has no spans; long texts and tokens are tested whole; repeated rows give repeated
results (and count each in the rules); null or repeated ids are as good as any; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import byte_words, cut, over_texts, picked, text_bytes

KINDS = ("assign", "access", "hex", "random")
TOKEN_LENGTH = 20
#: Lower ends of the strata of token length.
STRATA = (20, 28, 40, 64, 128)
#: Encodings from the narrowest alphabet to the widest; a token's is the first that has all its characters.
ALPHABETS = (
    "0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789+-/ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
)
_word = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
ASSIGN = re.compile(("(?:" + "|".join(map(_word, ("password", "passwd", "secret", "token"))) + "|" + _word("api") + "_?" + _word("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode())
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_BYTES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
TOKEN_BYTES = np.array([chr(b) in ALPHABETS[-1] for b in range(256)])
_SYMBOL = np.array([[max(x.find(chr(b)), 0) for b in range(256)] for x in ALPHABETS], np.int64)
_FITS = np.array([sum(1 << i for i, x in enumerate(ALPHABETS) if chr(b) in x) for b in range(256)], np.int64)
_SIZES = np.array([len(x) for x in ALPHABETS], np.int64)
_LETTERS = np.frombuffer(ALPHABETS[-1].encode(), np.uint8)
_TAIL = np.frompyfunc(math.erfc, 1, 1)
#: Weights of the three tests; a logit of a uniform p-value has variance pi^2 / 3.
WEIGHTS = (2, 1, 1)
#: A p-value counts as this at most: one test that fits well must not outweigh two that fail.
MOST = 0.95
#: Cells of randomness: quarter decades of the combined p-value; the last holds all beyond.
CELLS = 200
BLOCK_TOKENS = 1 << 13


def battery(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """For tokens of two characters or more: encoding (index in ALPHABETS), p-values `uniform`, `runs` and `serial` of
    randomness in that encoding, and `combined`: their weighted logits, whose sum is nearly normal."""
    n = ends - starts
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    byte = flat[np.repeat(starts - first, n) + np.arange(int(n.sum()))]
    fits = np.bitwise_and.reduceat(_FITS[byte], first)
    encoding = np.log2(fits & -fits).astype(np.int64)
    k = _SIZES[encoding]
    symbol = _SYMBOL[encoding[owner], byte]
    width = int(_SIZES.max())
    squares = (np.bincount(owner * width + symbol, minlength=width * len(n)).reshape(-1, width).astype(float) ** 2).sum(axis=1)
    freedom = k - 1.0
    statistic = np.maximum(squares * k / n - n, 0)
    uniform = _tail(((statistic / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom)))  # Wilson and Hilferty
    high = (symbol >= (k / 2)[owner]).astype(np.int64)
    a = np.add.reduceat(high, first).astype(float)
    inner = np.ones(len(byte), bool)
    inner[first] = False
    turns = np.bincount(owner[1:][inner[1:]], weights=(high[1:] != high[:-1])[inner[1:]], minlength=len(n))
    mean = 2 * a * (n - a) / n
    spread = np.sqrt(np.maximum(mean * (mean - 1) / np.maximum(n - 1, 1), 1e-9))
    runs = np.where(mean > 0, 2 * _tail(np.abs(turns - mean) / spread), 2.0 ** (1 - np.minimum(n, 1000)))
    centred = symbol - (np.add.reduceat(symbol, first) / n)[owner]
    power = np.add.reduceat(centred**2, first)
    product = np.bincount(owner[1:][inner[1:]], weights=(centred[1:] * centred[:-1])[inner[1:]], minlength=len(n))
    serial = np.where(power > 0, 2 * _tail(np.abs(product) / np.maximum(power, 1e-9) * np.sqrt(n)), 0.0)
    found = {"uniform": uniform, "runs": np.minimum(runs, 1), "serial": np.minimum(serial, 1)}
    bound = [np.clip(p, 1e-60, MOST) for p in found.values()]
    logits = sum(w * np.log(p / (1 - p)) for p, w in zip(bound, WEIGHTS, strict=True))
    return {"encoding": encoding, **found, "combined": _tail(-logits / math.sqrt(sum(w * w for w in WEIGHTS) * math.pi**2 / 3))}


def _tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of the normal distribution."""
    return 0.5 * _TAIL(z / math.sqrt(2)).astype(float)


def random_cells(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoding, and cell of the battery's combined p-value (0 for the most random), of each token."""
    encodings, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(starts), BLOCK_TOKENS):
        found = battery(flat, starts[i : i + BLOCK_TOKENS], ends[i : i + BLOCK_TOKENS])
        encodings.append(found["encoding"])
        out.append(np.minimum(-4 * np.log10(np.maximum(found["combined"], 1e-60)), CELLS - 1).astype(np.int64))
    return np.concatenate(encodings), np.concatenate(out)


def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat, offsets = text_bytes(batch.column(1))
    characters = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
    tokens: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    whole = flat.tobytes()

    def add(kind: int, row: int, start: int, end: int) -> None:
        rows[row].append((kind, start, end))

    def of(places: np.ndarray) -> np.ndarray:
        return np.unique(np.searchsorted(offsets, places, side="right") - 1)

    for row in of(np.flatnonzero((flat == ord(":")) | (flat == ord("=")))):
        for m in ASSIGN.finditer(whole[offsets[row] : offsets[row + 1]]):
            if m.end(1) - m.start(1) >= 8:
                add(0, row, offsets[row] + m.start(), offsets[row] + m.end())
    for row in of(np.array([m.start() for m in re.finditer(b"AKIA", whole)], np.int64)):
        for m in ACCESS.finditer(whole[offsets[row] : offsets[row + 1]]):
            if m.end() - m.start() >= 16:
                add(1, row, offsets[row] + m.start(), offsets[row] + m.end())
    starts, ends, owner = byte_words(flat, offsets, HEX_BYTES)
    for k in np.flatnonzero(ends - starts >= 32):
        add(2, owner[k], starts[k], ends[k])
    starts, ends, owner = byte_words(flat, offsets, TOKEN_BYTES)
    long = ends - starts >= TOKEN_LENGTH
    short = np.zeros(len(flat) + 1, np.int64)
    np.add.at(short, starts[~long], 1)
    np.add.at(short, ends[~long], -1)
    letters = np.bincount(flat[np.cumsum(short[:-1]) > 0], minlength=256)[_LETTERS]
    starts, ends, owner = starts[long], ends[long], owner[long]
    for k, (encoding, cell) in enumerate(zip(*random_cells(flat, starts, ends), strict=True)):
        row, start, end = owner[k], starts[k], ends[k]
        if not any(s <= start and end <= e for _, s, e in rows[row]):
            origin = characters[offsets[row]]
            own = np.bincount(flat[start:end], minlength=256)[_LETTERS]
            tokens[row].append({"start": int(characters[start] - origin), "end": int(characters[end] - origin), "stratum": int(np.searchsorted(STRATA, end - start, side="right")), "cell": int(cell), "even": float((end - start) * math.log(_SIZES[encoding])), "letters": own.tolist()})
    spans = [[{"start": int(characters[s] - characters[offsets[r]]), "rank": k, "end": int(characters[e] - characters[offsets[r]])} for k, s, e in found] for r, found in enumerate(rows)]
    # The slice's letter counts lie with its first row.
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS), pa.array(tokens, TOKENS), pa.array([letters.tolist()] + [None] * (batch.num_rows - 1), pa.list_(pa.int64()))], ["id", "base", "tokens", "plain"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
TOKENS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("cell", pa.int32()), ("even", pa.float64()), ("letters", pa.list_(pa.int64()))]))


def step_up(cells: list[tuple[int, int, int]], q: float) -> dict[int, int]:
    """By stratum, the least cell (quarter decade of p) that the step-up rule rejects at level q; cells: (stratum, cell,
    tokens)."""
    out = {}
    for stratum in {s for s, _, _ in cells}:
        counts = sorted(((c, n) for s, c, n in cells if s == stratum), reverse=True)
        m, above = sum(n for _, n in counts), 0
        for cell, n in counts:
            above += n
            if 10 ** (-cell / 4) <= q * above / m:
                out[stratum] = cell
    return out


def text_cell(token, log_shares: list[float]):
    """Quarter decades of the likelihood ratio of uniform letters against ordinary text."""
    text = F.aggregate(F.zip_with(token["letters"], F.array(*map(F.lit, log_shares)), lambda n, x: n * x), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.greatest(F.floor(4 * (-token["even"] - text) / math.log(10)), F.lit(0)), F.lit(CELLS - 1)).cast("int")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", q_random: float = 0.01, q_text: float = 1e-3) -> DataFrame:
    """id, base and spans: arrays of (start, rank in KINDS, end) in code points, end exclusive, by start then rank.

    One scan of the texts; its spans and tokens are kept as a table. The driver sees the corpus's letter counts and the
    counts of tokens by stratum and cell: at most 2,100 numbers, however large the corpus.
    """
    rows = picked(df, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, base array<struct<start:long,rank:int,end:long>>, tokens array<struct<start:long,end:long,stratum:int,cell:int,even:double,letters:array<long>>>, plain array<long>"
    scanned = cut(over_texts(rows, "text", scan_batch, schema))
    counts = scanned.filter("plain is not null").agg(*[F.coalesce(F.sum(F.get("plain", F.lit(i))), F.lit(0)) for i in range(len(_LETTERS))]).first()
    log_shares = [math.log((n + 1) / (sum(counts) + len(counts))) for n in counts]
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.stratum", "t.cell", text_cell(F.col("t"), log_shares).alias("text"))
    counted = {k: [tuple(r) for r in tokens.groupBy("stratum", k).count().collect()] for k in ("cell", "text")}
    not_random, not_text = step_up(counted["cell"], q_random), step_up(counted["text"], q_text)

    def admitted(t):
        passes = F.lit(False)
        for s, cell in sorted(not_text.items()):
            passes = passes | ((t["stratum"] == s) & (t["cell"] < not_random.get(s, CELLS)) & (text_cell(t, log_shares) >= cell))
        return passes

    extra = F.transform(F.filter("tokens", admitted), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    return scanned.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("spans"))


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
