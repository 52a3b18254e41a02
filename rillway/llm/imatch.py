"""Document fingerprints by I-Match, in DataFrame operations only.

Terms whose document frequency lies in a band (so whose inverse document frequency does) form the lexicon. A text's
distinct lexicon terms, as 64-bit hashes in ascending order, are hashed whole and for each of several randomised subsets
of the lexicon; a term's own hash says which subset, if any, holds it, so subsets need no tables.

The lexicon has at most (mean distinct terms of a text) / low terms, whatever the number of texts. Its size is checked:
up to max_listed terms it is one list in the plan, which Spark turns into a hash set; beyond, texts' terms are joined to
it as a table, with the same results.

Defined results: a null text counts as empty; a text with under FEW lexicon terms is hashed by all its distinct terms,
one without terms by itself, so that different texts differ (likeness counts only the terms that lie in a subset, so
short texts may be alike by the one or two they have there though others changed); equal texts have equal fingerprints, whatever their ids;
long texts are taken whole; null ids come first, and ties of ids are ordered by the text's hash; ids that are ordered
(imatch_edited) are numbers; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import picked

#: The first six bits of a term's hash are its slot; each of the 32 slots of hashes that are not negative is a randomised
#: subset, of 1 / 64 of the lexicon.
SLOT_SHIFT = 58
#: Below so many lexicon terms all terms of a text are taken.
FEW = 4
#: Rows are put in order in blocks of about so many bytes of text, but never in more blocks than the driver can list.
#: Small tables get a block for each shuffle partition, of LEAST_BYTES at least.
BLOCK_BYTES, MAX_BLOCKS, LEAST_BYTES = 32 << 20, 8192, 1 << 20


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct terms: lower-cased runs of ASCII letters and digits and of all beyond ASCII."""
    parts = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, low: float, high: float) -> DataFrame:
    """term (its hash) of the terms in a share of the texts between low and high, and in two at least."""
    n = texts.count()
    counted = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).select("term")


class Lexicon:
    """The lexicon of a table of texts (id, key, text), as a list where it is small, else as a table."""

    def __init__(self, texts: DataFrame, low: float, high: float, max_listed: int):
        self.table = lexicon(texts, low, high)
        few = [r[0] for r in self.table.limit(max_listed + 1).collect()]  # a check of the size, not a cut
        self.listed = sorted(few) if len(few) <= max_listed else None

    def with_terms(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """rows (id, key, ...) with `out`: the hashes of the text's lexicon terms, or of all terms of texts with few."""
        rows = rows.withColumn("_all", term_hashes(F.col(text)))
        if self.listed is None:
            near = rows.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.explode("_all").alias("term"))
            held = near.join(self.table, "term").groupBy("_id", "_key").agg(F.collect_set("term").alias("_held"))
            rows = rows.join(held, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key")
        elif self.listed:
            rows = rows.withColumn("_held", F.expr(f"filter(_all, t -> t IN ({', '.join(f'{t}L' if t > -(2**63) else 'bigint(-9223372036854775808)' for t in self.listed)}))"))
        else:
            rows = rows.withColumn("_held", F.lit(None).cast("array<bigint>"))
        return rows.withColumn(out, F.sort_array(F.when(F.size("_held") >= FEW, F.col("_held")).otherwise(F.col("_all")))).drop("_all", "_held")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fingerprint(terms: str, text: Column) -> Column:
    """whole: the hash of a text's sorted term hashes; subsets: one for each subset with a term of the text, ascending,
    its first bits being the subset's slot. Sorted hashes come slot by slot, so each subset is a slice."""
    slot = lambda x: F.shiftright(x, SLOT_SHIFT)

    def subsets(own: Column) -> Column:
        n = F.size(own)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (slot(F.get(own, i)) != slot(F.get(own, i - 1))))

        def hashed(heads: Column) -> Column:
            part = lambda h, k: F.xxhash64(F.slice(own, h + 1, F.coalesce(F.get(heads, k + 1), n) - h))
            return F.transform(heads, lambda h, k: F.shiftleft(slot(F.get(own, h)), SLOT_SHIFT).bitwiseOR(F.shiftrightunsigned(part(h, k), 64 - SLOT_SHIFT)))

        return F.when(n > 0, _bound(heads, hashed)).otherwise(F.array().cast("array<bigint>"))

    whole = F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.xxhash64(text))
    return F.struct(whole.alias("whole"), _bound(F.filter(terms, lambda x: x >= 0), subsets).alias("subsets"))


def shown(prints: str) -> Column:
    return F.concat_ws(".", F.lower(F.hex(f"{prints}.whole")), F.array_join(F.transform(f"{prints}.subsets", lambda x: F.lower(F.hex(x))), "."))


def likeness(a: str, b: str) -> Column:
    """Share of equal subset hashes among the subsets that either has; where neither has any, 1 for equal whole hashes."""
    slots = lambda c: F.transform(f"{c}.subsets", lambda x: F.shiftright(x, SLOT_SHIFT))
    either = F.size(F.array_union(slots(a), slots(b)))
    equal = F.size(F.array_intersect(f"{a}.subsets", f"{b}.subsets"))
    return F.when(either > 0, equal / either).otherwise((F.col(f"{a}.whole") == F.col(f"{b}.whole")).cast("double"))


def _listed(values: list) -> Column:
    return F.expr(f"array({', '.join(map(repr, values))})")


def _level(bounds: list, id_: Column) -> Column:
    """How many of the ascending bounds are not above the id, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda a: F.size(F.filter(a, lambda b: b <= id_))
    group = upto(_listed([g[0] for g in groups]))
    inner = F.expr(f"array({', '.join(f'array({", ".join(map(repr, g))})' for g in groups)})")
    return F.when(group == 0, 0).otherwise((group - 1) * step + upto(F.get(inner, F.greatest(group - 1, F.lit(0)))))


def with_block(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows (id, key, text) with `block`, ascending in (id, key), nulls first; blocks hold about block_bytes of text.

    Blocks are cut at approximate quantiles of the ids. The rows of an id that fills several blocks, and null ids, are
    dealt over theirs by key, which is a hash and so even.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count("id").alias("ids")).first()
    least = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // LEAST_BYTES))
    blocks = min(MAX_BLOCKS, max(1, least, -(-(size["bytes"] or 0) // block_bytes)))
    nulls = -(-blocks * (size["n"] - size["ids"]) // max(size["n"], 1))
    cuts: list = []
    if blocks > 1 and size["ids"]:
        shares = ", ".join(f"{i / blocks}D" for i in range(1, blocks))
        cuts = sorted(rows.agg(F.percentile_approx("id", F.expr(f"array({shares})"), 10 * blocks).alias("q")).first()["q"])
    unit = F.col("key") / F.lit(2.0**64) + 0.5
    among = lambda m: F.least(F.floor(unit * m), F.lit(m) - 1)
    block = _level(cuts, F.col("id"))
    crowded = [(u, cuts.index(u), cuts.count(u)) for u in sorted({u for u, v in zip(cuts, cuts[1:], strict=False) if u == v})]
    if crowded:
        listed = F.expr(f"array({', '.join(f'struct({u!r} AS u, {p} AS p, {m} AS m)' for u, p, m in crowded)})")
        own = F.get(F.filter(listed, lambda x: x["u"] == F.col("id")), F.lit(0))
        block = F.coalesce(own["p"] + 1 + among(own["m"]), block)
    return rows.withColumn("block", F.when(F.col("id").isNull(), among(nulls) - nulls).otherwise(block).cast("int"))


def ordered(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows (id, key, text) with `block` and `copy`: each block has a copy of the row that follows its last, so that
    neighbours can be found within blocks. The driver sees one id and key per block, never rows."""
    own = with_block(rows, block_bytes)
    firsts = sorted(((r["block"], r["f"]["id"], r["f"]["key"]) for r in own.groupBy("block").agg(F.min(F.struct("id", "key")).alias("f")).collect()), key=lambda x: x[0])
    own = own.withColumn("copy", F.lit(False))
    if not firsts:
        return own
    kind = rows.schema["id"].dataType.simpleString()
    moves = rows.sparkSession.createDataFrame([(name, key, firsts[i - 1][0]) for i, (_, name, key) in enumerate(firsts)], f"to_id {kind}, to_key long, block int")
    # At most MAX_BLOCKS rows and those of null ids, so the broadcast is bounded.
    copies = rows.join(F.broadcast(moves), F.col("id").eqNullSafe(F.col("to_id")) & (F.col("key") == F.col("to_key"))).dropDuplicates(["to_id", "to_key", "block"]).drop("to_id", "to_key")
    return own.unionByName(copies.withColumn("copy", F.lit(True)))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(df, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))


def imatch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.005, high: float = 0.2, max_listed: int = 100_000) -> DataFrame:
    """id, text, prints: the fingerprint of each text (whole, subsets)."""
    texts = _texts(df, id_col, text_col)
    done = Lexicon(texts, low, high, max_listed).with_terms(texts, "text", "terms")
    return done.select(F.col("id").alias(id_col), "text", fingerprint("terms", F.col("text")).alias("prints"))


def imatch_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.005, high: float = 0.2, max_listed: int = 100_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against itself
    with its second half replaced by the head of the next text, and against the next text."""
    texts = _texts(df, id_col, text_col)
    held = Lexicon(texts, low, high, max_listed)
    own = held.with_terms(ordered(texts, block_bytes), "text", "terms").withColumn("prints", fingerprint("terms", F.col("text"))).drop("terms")
    order = Window.partitionBy("block").orderBy("copy", F.col("id").asc_nulls_first(), "key")
    paired = own.withColumn("next", F.lead(F.struct("text", "prints")).over(order)).filter("not copy")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = paired.select("id", n.cast("long").alias("n_chars"), "prints", F.col("next.prints").alias("next_prints"), edited.alias("edited"))
    done = held.with_terms(rows.withColumn("key", F.xxhash64("edited")), "edited", "terms").withColumn("edited_prints", fingerprint("terms", F.col("edited")))
    return done.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("prints").alias("fingerprint"), shown("edited_prints").alias("edited_fingerprint"),
        likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"),
    )
