"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Texts are shingled into five lower-cased words. Texts lie in chunks that are shuffled once and read twice: each chunk
tells its shingles to buckets, which answer each one's document frequency; then weights are known: tf * idf with the
usual smooth idf = 1 + ln((1 + N) / (1 + df)). A text can be near another only if shingles that other texts have make up
`threshold` of its weight, so only such texts are sampled. A sample is the (shingle, level) of least weighted hash;
`rows` samples make a band key.

Members of a band are compared (never all with all) with three of them: the one whose shingles are the most common,
which is the original where copies were edited apart, and those of least and greatest key. Verified links are closed into
classes. Where the members of a band are then of several classes, all of them are compared with all texts of such
bands by an exact join (`crossing`): with each text's shingles in order from the rarest, two texts of similarity t share
one from which on the larger text has t of its weight left, and the smaller one 2t / (1 + t). So every pair that shares a
band ends in one class. A pair of TF-IDF similarity 0.8 shares a band with probability 0.9998; one of similarity 0.8
by tf and 0.65 by TF-IDF with 0.9994.

Two texts are near if their weighted Jaccard similarity is `threshold` or more, by the weights tf * idf or by tf alone:
where a text was copied often, words that an edit made rare outweigh by idf what all copies share, and copies that
differ in a few words would fall apart.

Exact copies are one text (its key is the md5): they share a class without entering the comparison, and count in df.

Defined results: a null text is an empty text of its own key; texts of under five words have one shingle of all their
words; texts without words are near only their exact copies; null or repeated ids are allowed, a class bears its
least id; long texts are taken whole; other columns, whatever their names, are ignored (near_dedup) or kept (keep_one);
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import byte_words, cut, mix64, picked, placed, spread_join, text_bytes, word_hashes
from rillway.llm.suffix_dedup import _numbers, _split

WORD_BYTES = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_STEPS = mix64(np.arange(91, 99, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of a column, distinct by row, ordered by row then shingle."""
    flat, offsets = text_bytes(texts)
    starts, ends, rows = byte_words(flat, offsets, WORD_BYTES)
    words = word_hashes(LOWER[flat], starts, ends)
    n = len(words)
    counts = np.bincount(rows, minlength=len(texts))
    first = (np.cumsum(counts) - counts)[rows]
    left = first + counts[rows] - np.arange(n)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        inside = left > k
        value[: n - k] += np.where(inside[: n - k], words[k:], np.uint64(0)) * _STEPS[k]
    whole = (left >= width) | (np.arange(n) == first)
    value, rows = mix64(value[whole]), rows[whole]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))) if len(value) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    return rows[at], value[at], np.diff(np.append(at, len(value)))


def _codes(value: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of each shingle; the order in which a chunk tells them."""
    return (value % np.uint64(buckets)) << np.uint64(40) | value >> np.uint64(24)


def _own_texts(texts: pa.Table, notes: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The chunk's texts that stand for their copies, and how many copies each has."""
    copies = {k: n for k, n in zip(notes.column("key").to_pylist(), notes.column("copies").to_pylist(), strict=True) if k is not None}
    keys, place = texts.column("key").to_pylist(), {}
    for i, k in enumerate(keys):
        if k in copies:
            place.setdefault(k, i)
    order = sorted(place)
    return texts.take(pa.array([place[k] for k in order], pa.int64())), np.array([copies[k] for k in order], np.int64)


TOLD = "bucket int, chunk int, high binary, low binary, df binary, texts binary"
NOTES = "chunk int, bucket int, key string, copies long, df binary, texts binary"
SAMPLED = "key string, rarity double, bands array<long>, shingles binary, idf binary, times binary"


def tell(texts: pa.Table, notes: pa.Table, buckets: int) -> pa.Table:
    names = [x.split()[0] for x in TOLD.split(", ")]
    own, copies = _own_texts(texts, notes)
    rows, value, _ = shingles(own.column("text").combine_chunks() if own.num_rows else pa.array([], pa.string()))
    code, at = np.unique(_codes(value, buckets), return_inverse=True)
    df = np.bincount(at, weights=copies[rows].astype(float), minlength=len(code)).astype(np.uint32)
    near = np.minimum(np.bincount(at, minlength=len(code)), 255).astype(np.uint8)
    found, (high, low, d, t) = _split((code >> np.uint64(40)).astype(np.int64), buckets, [(code >> np.uint64(32)).astype(np.uint8), code.astype(np.uint32), df, near])
    chunk = [texts.column("chunk")[0].as_py()] * len(found) if len(found) else []
    return pa.table(dict(zip(names, [pa.array(found.astype(np.int32)), pa.array(chunk, pa.int32()), *(pa.array(x, pa.binary()) for x in (high, low, d, t))], strict=True)))


def answer(table: pa.Table) -> pa.Table:
    """For each chunk the corpus's counts of its shingles, in the order in which it told them."""
    value = _numbers(table.column("high"), np.uint8).astype(np.uint64) << np.uint64(32) | _numbers(table.column("low"), np.uint32).astype(np.uint64)
    _, at = np.unique(value, return_inverse=True)
    df = np.bincount(at, weights=_numbers(table.column("df"), np.uint32).astype(float))[at].astype(np.uint32) if len(at) else at
    near = np.minimum(np.bincount(at, weights=_numbers(table.column("texts"), np.uint8).astype(float))[at], 255).astype(np.uint8) if len(at) else at
    edges = np.cumsum([0, *(len(x) for x in table.column("high").to_pylist())])
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    n = table.num_rows
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "key": pa.nulls(n, pa.string()), "copies": pa.nulls(n, pa.int64()), "df": part(df), "texts": part(near)})


def weighted_samples(value: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int):
    """For each sample, the code (shingle and level) that improved consistent weighted sampling takes of each text.

    Per shingle and sample: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln w / r + b), ln y = r (t - b),
    ln a = ln c - ln y - r; the least a is taken. starts: first entry of each text.
    """
    log_w = np.log(weight).astype(np.float32)
    sizes = np.diff(np.append(starts, len(value)))
    unit = np.float32(2.0**-24)

    def uniform(x, shift):
        return ((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) * unit + unit / 2

    for j in range(samples):
        x = mix64(value + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        y = x * np.uint64(0xD1B54A32D192ED03)
        y ^= y >> np.uint64(31)
        r = -np.log(uniform(x, 0) * uniform(x, 32))
        c = -np.log(uniform(y, 8) * uniform(y, 36))
        b = uniform(x ^ (y >> np.uint64(7)), 20)
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, sizes))
        owner = np.searchsorted(starts, at, side="right") - 1
        at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
        yield mix64(value[at] + t[at].astype(np.int64).astype(np.uint64) * _STEPS[5])


def smooth_idf(df: np.ndarray, n_texts: int) -> np.ndarray:
    return 1 + np.log((1 + n_texts) / (1 + np.minimum(df, n_texts)))


def sample(texts: pa.Table, notes: pa.Table, buckets: int, n_texts: int, threshold: float, bands: int, rows_each: int) -> pa.Table:
    own, _ = _own_texts(texts, notes)
    rows, value, times = shingles(own.column("text").combine_chunks() if own.num_rows else pa.array([], pa.string()))
    code, at = np.unique(_codes(value, buckets), return_inverse=True)
    told = notes.filter(pa.compute.is_valid(notes.column("df"))).sort_by("bucket") if notes.num_rows else notes
    df, near = _numbers(told.column("df"), np.uint32), _numbers(told.column("texts"), np.uint8)
    if len(df) != len(code):
        raise RuntimeError("a chunk's answers don't fit its texts")
    weight = times * smooth_idf(df[at], n_texts)
    n = own.num_rows
    sums = lambda w: np.bincount(rows, weights=w, minlength=n)
    total, length = sums(weight), sums(times)
    chosen = (total > 0) & ((sums(weight * (near[at] > 1)) >= threshold * total - 1e-9) | (sums(times * (near[at] > 1)) >= threshold * length - 1e-9))
    take = chosen[rows]
    rows, value, weight, times = rows[take], value[take], weight[take], times[take]
    order, starts = np.unique(rows, return_index=True)
    keys = [] if not len(order) else [np.array(0)]
    if len(order):
        keys = []
        for by, number in ((weight, bands), (times.astype(float), -(-bands // 2))):
            codes = weighted_samples(value, by, starts, number * rows_each)
            for _ in range(number):
                k = np.full(len(order), len(keys) + 1, np.uint64)
                for _ in range(rows_each):
                    k = mix64(k * _STEPS[6] + next(codes))
                keys.append(k.view(np.int64))
    ends = np.append(starts, len(rows))[1:]
    columns = (value, (weight / times).astype(np.float32), times.astype(np.uint32))
    blobs: tuple[list, list, list] = ([], [], [])
    for a, b in zip(starts, ends, strict=True):
        turn = np.argsort(columns[0][a:b], kind="stable")
        for blob, column in zip(blobs, columns, strict=True):
            blob.append(column[a:b][turn].tobytes())
        if columns[2][a:b].max() == 1:
            blobs[2][-1] = b""  # all once
    lists = np.stack(keys, axis=1).tolist() if keys else []
    names = own.column("key").take(pa.array(order, pa.int64())) if n else pa.array([], pa.string())
    rarity = total[order] / np.maximum(length[order], 1) if n else np.zeros(0)
    found = {"key": names, "rarity": pa.array(rarity, pa.float64()), "bands": pa.array(lists, pa.list_(pa.int64()))}
    return pa.table(found | {k: pa.array(x, pa.binary()) for k, x in zip(("shingles", "idf", "times"), blobs, strict=True)})


class Bag:
    """A text's shingles, ascending, with their idf and times, from its blobs."""

    def __init__(self, shingles: bytes, idf: bytes, times: bytes):
        self.shingles, self.idf = np.frombuffer(shingles, np.uint64), np.frombuffer(idf, np.float32)
        self.times = np.frombuffer(times, np.uint32) if times else np.ones(len(self.shingles), np.uint32)
        self.weights = (self.times * self.idf).astype(np.float64)


def similarity(a: Bag, b: Bag) -> float:
    """The larger of the weighted Jaccard similarities by tf * idf and by tf."""
    at = np.searchsorted(b.shingles, a.shingles)
    hit = b.shingles[np.minimum(at, len(b.shingles) - 1)] == a.shingles
    out = 0.0
    for u, v in ((a.weights, b.weights), (a.times, b.times)):
        least = float(np.minimum(u[hit], v[at[hit]]).sum(dtype=np.float64))
        out = max(out, least / (float(u.sum(dtype=np.float64) + v.sum(dtype=np.float64)) - least))
    return out


BLOBS = ("shingles", "idf", "times")


def _of(texts: DataFrame, side: str, **names: str) -> DataFrame:
    """Columns of texts under new names, with the blobs named for their side."""
    return texts.select(*[F.col(c).alias(new) for new, c in names.items()], *[F.col(c).alias(side + c) for c in BLOBS])


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The x and y of the pairs whose texts (a..., b...) are near."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                a, b = (map(Bag, *[part.column(side + c).to_pylist() for c in BLOBS]) for side in "ab")
                keep = [similarity(x, y) >= threshold - 1e-6 for x, y in zip(a, b, strict=True)]
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("x", "y", *[side + c for side in "ab" for c in BLOBS]).mapInArrow(run, "x string, y string")


def closed(links: DataFrame) -> DataFrame:
    """key and root (least key of its component) of all keys in links (x, y): least-label spreading with jumps to the
    label's label, until nothing changes. Each round is a table in the shared folder."""
    both = cut(links.select(F.col("x").alias("key"), F.col("y").alias("other")).union(links.select("y", "x")).distinct())
    labels = cut(both.groupBy("key").agg(F.least("key", F.min("other")).alias("root")))
    while True:
        seen = spread_join(both, labels.select(F.col("key").alias("other"), "root"), "other").groupBy("key").agg(F.min("root").alias("seen"))
        nearer = cut(labels.join(seen, "key").select("key", "root", F.least("root", "seen").alias("next")))
        # The members of a class all ask for its root's label: dealt over parts, as a hub's neighbours are above.
        jumped = spread_join(nearer, labels.select(F.col("key").alias("next"), F.col("root").alias("beyond")), "next", "left")
        moved = cut(jumped.select("key", F.least("next", F.coalesce("beyond", "next")).alias("root"), (F.least("next", F.coalesce("beyond", "next")) != F.col("root")).alias("moved")))
        labels = moved.select("key", "root")
        if moved.filter("moved").isEmpty():
            return labels


PROBE = "shingle long, id long, root string, rest_w double, total_w double, rest_t double, total_t double"


def rare_shingles(texts: DataFrame, threshold: float) -> DataFrame:
    """PROBE: of each text (id, root, shingles, idf, times) the shingles, from the rarest on, up to the point where less
    than `threshold` of its weight by tf * idf (w) and by tf (t) is left, with what is left and in all."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], [], [], []]
                for row in batch.slice(i, 256).to_pylist():
                    bag = Bag(*(row[c] for c in BLOBS))
                    order = np.lexsort((bag.shingles, -bag.idf))
                    rest = [np.cumsum(x[order][::-1], dtype=np.float64)[::-1] for x in (bag.weights, bag.times)]
                    keep = (rest[0] >= threshold * rest[0][0]) | (rest[1] >= threshold * rest[1][0])
                    n = int(keep.sum())
                    for column, x in zip(out, (bag.shingles[order][keep].view(np.int64), np.full(n, row["id"]), [row["root"]] * n, rest[0][keep], np.full(n, rest[0][0]), rest[1][keep], np.full(n, rest[1][0])), strict=True):
                        column.append(x)
                kinds = (np.int64, np.int64, None, *[np.float64] * 4)
                arrays = [pa.array([r for x in c for r in x], pa.string()) if k is None else pa.array(np.concatenate([np.zeros(0, k), *c])) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PROBE.split(", ")])

    return texts.select("id", "root", *BLOBS).mapInArrow(run, PROBE)


def crossing(texts: DataFrame, threshold: float) -> DataFrame:
    """i and j, ids of texts of different roots: all pairs that can have similarity `threshold` or more. Only the
    shingles of rare_shingles meet, and only if what is left of both texts from there on can suffice."""
    t = threshold - 1e-5  # sums of weights are rounded
    probe = cut(rare_shingles(texts, t))
    several = probe.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    probe = cut(probe.join(several, "shingle", "left_semi"))
    few = 2 * t / (1 + t)
    a, b = probe.filter(f"rest_w >= {few} * total_w or rest_t >= {few} * total_t").alias("a"), probe.alias("b")

    def can(m: str):
        ta, tb, ra, rb = (F.col(f"{side}.{x}_{m}") for x in ("total", "rest") for side in "ab")
        smaller = (ta < tb) | (ta == tb) & (F.col("a.id") < F.col("b.id"))
        return smaller & (F.least(ra, rb) >= t / (1 + t) * (ta + tb))

    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & (can("w") | can("t")))
    return met.select(F.least("a.id", "b.id").alias("i"), F.greatest("a.id", "b.id").alias("j")).distinct()


def text_key(text_col: str):
    return F.coalesce(F.md5(F.col(text_col)), F.lit("null"))


def band_links(members: DataFrame, sampled: DataFrame, threshold: float) -> DataFrame:
    """x and y, keys of near texts: each member of a band (key, rarity, band) against three of the band."""
    ends = members.groupBy("band").agg(F.min(F.struct("rarity", "key")).getField("key").alias("lead"), F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    met = spread_join(members.select("key", "band"), ends, "band").select(F.col("key").alias("x"), F.explode(F.array_distinct(F.array("lead", "low", "high"))).alias("y"))
    pairs = cut(met.filter("x <> y").distinct())
    held = spread_join(pairs, _of(sampled, "b", y="key"), "y").join(_of(sampled, "a", x="key"), "x")
    return _verified(held, threshold)


#: Rows of one text in a chunk from which on a single one stands for them.
CROWD = 64


def class_roots(df: DataFrame, threshold: float, bands: int, rows_each: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """key and root of the texts that are near others: the root is one key of the class. df: id, text."""
    size = df.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    chunks, buckets = max(1, -(-(size["bytes"] or 0) // chunk_bytes)), max(64, -(-(size["bytes"] or 0) // bucket_bytes))
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")
    texts = df.select(chunk.alias("chunk"), text_key("text").alias("key"), "text")
    met = cut(texts.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")))
    crowd = met.filter(F.col("n") > CROWD).select("key", "chunk")
    if not crowd.isEmpty():
        # Rows of equal id and text have one chunk: of a crowd of them one row is sent.
        one = texts.join(crowd, ["key", "chunk"], "left_semi").groupBy("chunk", "key").agg(F.first("text").alias("text"))
        texts = texts.join(crowd, ["key", "chunk"], "left_anti").select("chunk", "key", "text").unionByName(one)
    standing = met.groupBy("key").agg(F.min("chunk").alias("chunk"), F.sum("n").alias("copies"))
    nothing = F.lit(None).cast("binary")
    notes = cut(standing.select("chunk", F.lit(-1).alias("bucket"), "key", "copies", nothing.alias("df"), nothing.alias("texts")))
    by_chunk = texts.groupBy("chunk")
    told = by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(lambda t, n: tell(t, n, buckets), TOLD)
    answers = told.groupBy("bucket").applyInArrow(answer, NOTES)
    n = max(size["rows"], 1)
    sampled = cut(by_chunk.cogroup(notes.unionByName(answers).groupBy("chunk")).applyInArrow(lambda t, m: sample(t, m, buckets, n, threshold, bands, rows_each), SAMPLED))
    members = sampled.select("key", "rarity", F.explode("bands").alias("band"))
    roots = closed(band_links(members, sampled, threshold))
    rooted = cut(sampled.select("key", "bands").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    banded = rooted.select("key", "root", F.explode("bands").alias("band"))
    mixed = banded.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    several = spread_join(banded, mixed, "band").select("key", "root").distinct()
    left = cut(sampled.select("key", *BLOBS).join(several, "key").withColumn("id", F.monotonically_increasing_id()))
    pairs = cut(crossing(left, threshold))
    near = spread_join(spread_join(pairs, _of(left, "a", i="id", x="root"), "i"), _of(left, "b", j="id", y="root"), "j", counted=pairs)
    merged = closed(_verified(near, threshold).distinct()).select(F.col("key").alias("root"), F.col("root").alias("last"))
    return spread_join(rooted.select("key", "root"), merged, "root", "left").select("key", F.coalesce("last", "root").alias("root"))


def classes(rows: DataFrame, texts: DataFrame, threshold: float, bands: int, rows_each: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """key, class_id (least id of the class), class_rows, leads (one key of each class); one row per distinct text.
    rows: id, key, a table; texts: id, text."""
    roots = class_roots(texts, threshold, bands, rows_each, chunk_bytes, bucket_bytes)
    copies = rows.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    rooted = cut(copies.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    found = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("first"), F.sum("n").alias("class_rows"))
    return cut(spread_join(rooted, found, "root").select("key", F.col("first.low").alias("class_id"), "class_rows", (F.col("key") == F.col("first.key")).alias("leads")))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 16, rows_each: int = 4, chunk_bytes: int = 1 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """id, class_id (least id of the class), class_rows, stays (one row of each class; rows of one id and text alike);
    one row per row of df."""
    texts = picked(df, id=id_col, text=text_col)
    rows = cut(texts.select("id", text_key("text").alias("key")))
    known = classes(rows, texts, threshold, bands, rows_each, chunk_bytes, bucket_bytes)
    return spread_join(rows, known, "key").select(F.col("id").alias(id_col), "class_id", "class_rows", (F.col("leads") & F.col("id").eqNullSafe(F.col("class_id"))).alias("stays"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 16, rows_each: int = 4, chunk_bytes: int = 1 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """df with one row of each class: the row of least id (of repeated rows one) that bears the class's leading text."""
    whole, (id_, text) = placed(df, id_col, text_col)
    texts = whole.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    rows = cut(texts.select("id", text_key("text").alias("key")))
    held = classes(rows, texts, threshold, bands, rows_each, chunk_bytes, bucket_bytes).filter("leads").select(F.col("key").alias("_of"), F.col("class_id").alias("_id"))
    kept = whole.withColumn("_key", text_key(text)).join(held, (F.col("_key") == F.col("_of")) & F.col(id_).eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates([id_, "_key"]).drop("_key").toDF(*df.columns)
