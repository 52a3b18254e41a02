"""URL filters over a sorted digest array.

Rules (host, path, action) are stored once as a file in the shared folder: sorted 64-bit xxhash keys, then the full
strings. Executors map it into memory; a url's host suffixes and path prefixes are hashed and probed by vectorised
binary search, and a hit counts only if the stored string is equal, so colliding digests can't match. Rule files
over max_bytes go another way: a join on the keys.

Defined results: a null url, or one without ://, has empty host and path and matches no rule; the longest rule
string wins, among equals the one with the longer host; a rule given twice counts once, block before allow; without
rules every url has the default verdict; long urls are judged whole; repeated rows and null ids give repeated results;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import new_path, picked

ACTIONS = ("allow", "block")
RESULTS = ("host", "path", "rule", "verdict")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path): what follows the first :// up to / ? # or end, then up to ? # or end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _sorted_rules(rules: list[tuple[str, str, str]]) -> list[tuple[int, bytes, int]]:
    actions: dict[str, int] = {}
    for host, path, action in rules:
        actions[host + path] = max(actions.get(host + path, 0), ACTIONS.index(action))
    return sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), a) for k, a in actions.items())


def most_labels(rules: list[tuple[str, str, str]]) -> int:
    return max((h.count(".") + 1 for h, _, _ in rules), default=0)


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The file: rule count, most labels of a rule's host, distinct path lengths with their count, digests, ends of
    strings, actions, strings."""
    entries = _sorted_rules(rules)
    lengths = sorted({len(p) for _, p, _ in rules})
    ends = np.cumsum([len(s) for _, s, _ in entries], dtype=np.uint64) if entries else np.zeros(0, np.uint64)
    head = np.array([len(entries), most_labels(rules), len(lengths), *lengths], np.uint64)
    digests = np.array([d for d, _, _ in entries], np.uint64)
    return head.tobytes() + digests.tobytes() + ends.tobytes() + bytes(a for _, _, a in entries) + b"".join(s for _, s, _ in entries)


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, self.labels, k = (int(x) for x in whole[:24].view(np.uint64))
        at = 24 + 8 * k
        self.lengths = [int(x) for x in whole[24:at].view(np.uint64)]
        self.digests = whole[at : at + 8 * n].view(np.uint64)
        self.ends = whole[at + 8 * n : at + 16 * n].view(np.uint64)
        self.actions = whole[at + 16 * n : at + 17 * n]
        self.strings = whole[at + 17 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, or -1."""
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < len(self.digests)]
            open_ = open_[self.digests[at[open_]] == wanted[open_]]
            same = np.array([self.string(at[i]) == keys[i] for i in open_], bool)
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()


@functools.cache
def mapped(path: str) -> DigestArray:
    return DigestArray(path)


def candidates(host: str, path: str, lengths: list[int], most: int) -> list[str]:
    """The keys that could be a rule for the url, the winner first; rules have `most` labels in their hosts at most."""
    labels = host.rsplit(".", most)[-most:] if host and most else []
    pairs = [(h, path[:n]) for h in (".".join(labels[i:]) for i in range(len(labels))) for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(pairs, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def publish(spark: SparkSession, data: bytes) -> str:
    """Put a small file into the shared folder and announce it to all executors; its name."""
    path = new_path(spark, "digests")
    name = path.rsplit("/", 1)[-1]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(place.toUri().toString())
    return name


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = 256 << 20) -> DataFrame:
    """id, host, path, rule (host and path of the winning rule, or null), verdict; one row per row of df.

    rules: (host, path, allow or block) held by the driver. default: the verdict where no rule fits.
    """
    spark = df.sparkSession
    if id_col.lower() in RESULTS:
        raise ValueError(f"the id column can't be named {id_col}")
    host, path = url_parts(F.col("url"))
    parts = picked(df, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    data = pack(rules)
    if len(data) > max_bytes:
        return _by_join(parts, rules, default).withColumnRenamed("id", id_col)
    name = publish(spark, data)

    def run(batches):
        array = mapped(SparkFiles.get(name))
        for batch in batches:
            wanted, owner = [], []
            for row, (h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                keys = candidates(h, p, array.lengths, array.labels)
                wanted += [k.encode() for k in keys]
                owner += [row] * len(keys)
            hits = array.find(wanted)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for k in np.flatnonzero(hits >= 0)[::-1]:  # the winner is the first, so it is set last
                rule[owner[k]], verdict[owner[k]] = wanted[k].decode(), ACTIONS[array.actions[hits[k]]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", *RESULTS])

    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} string" for c in RESULTS)).withColumnRenamed("id", id_col)


def _by_join(parts: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """For rule sets that executors shouldn't map: distinct (host, path), their candidate keys, a join, the longest."""
    spark = parts.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    if not rules:
        return parts.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    held = spark.createDataFrame([(s.decode(), ACTIONS[a]) for _, s, a in _sorted_rules(rules)], "rule string, verdict string")
    labels = F.split("host", r"\.")
    pairs = parts.select("host", "path").distinct().filter("host <> ''")
    suffixes = pairs.select("host", "path", F.explode(F.transform(F.sequence(F.greatest(F.size(labels) - most_labels(rules) + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("h"))
    keys = suffixes.select("host", "path", "h", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter(F.length("path") >= F.col("n"))
    hits = keys.withColumn("rule", F.concat("h", F.expr("substring(path, 1, n)"))).join(held, "rule")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("h"))).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
