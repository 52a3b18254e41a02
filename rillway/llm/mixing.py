"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket; the bucket where a source's budget runs out is the only one refined,
level by level, until a cell of hashes holds one document. Documents below their source's threshold are taken: no sort over
documents, no state that grows with them. Three levels split by the id's hash; a cell where several rows are left (null or
repeated ids) is split by the text's hash on three more, and of equal rows in the last cell as many are taken as fit.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a null id hashes
as the empty string; of rows with equal id and text, any may be taken, but their number is settled; long texts are counted
whole; an empty table gives an empty result; other columns pass through unless they bear a result's name, in any case, which
then holds the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import cut, placed

#: Bits of the hash, and of each level of the histogram.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3
CELL_BITS = LEVEL_BITS * LEVELS


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int"), F.lit(0)).cast("long")


def row_hash(id_column: Column) -> Column:
    """60 bits of the id's md5, which every SQL engine can recompute."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. Sources in code point order, null last, get the weights in turn; targets share
    `share` of all sizes by weight, none above `most` times its source's size (needs share <= most).

    With sources by ascending size per weight, a prefix of them is capped; the rest share what is left. The windows
    run over one row per source.
    """
    names = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)))
    named = names.withColumn("weight", weight)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = named.withColumn("level", level)
    # Below the first source that stays under its cap all are capped; its level is everyone's from there on.
    own = F.min_by(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level")), F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("source_size") / F.col("weight"))).over(everything)
    target = F.least(F.coalesce(own, F.lit(float("inf"))) * F.col("weight"), most * F.col("source_size"))
    return levels.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).cast("double").alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `whole` (times that each document is taken anyway), cells and `number`: documents whose (cell, finer)
    lies under (below, finer_below) are taken once more, and of those there as many as `number`, so that at least half of
    the last one fits. finer_below is null where the id's hash has told all documents apart. number of rows there: `n`."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(0).cast("long")).withColumn("finer_below", F.lit(None).cast("long")).withColumn("n", F.lit(2).cast("long")).withColumn("mass", F.lit(0).cast("long"))
    for level in range(1, 2 * LEVELS + 1):
        finer = level > LEVELS
        if level == LEVELS + 1 and state.filter("n > 1").isEmpty():
            break
        state = cut(_refined(sized, state, "finer" if finer else "cell", "finer_below" if finer else "below", CELL_BITS - LEVEL_BITS * (level - LEVELS * finer)))
    fits = F.when(F.col("mass") > 0, F.least(F.col("n"), F.floor(F.col("rest") * F.col("n") / F.col("mass") + 0.5))).otherwise(F.lit(0))
    return state.select("source", "source_size", "target", "whole", "below", "finer_below", fits.cast("long").alias("number"), "n")


def _refined(sized: DataFrame, state: DataFrame, split: str, prefix: str, shift: int) -> DataFrame:
    """state one level on: `prefix` is the boundary cell at `shift` bits of the column `split` (`cell`, or `finer` within a
    settled cell), the first that overruns the budget; rest, what is left for it; mass and n, its words and rows."""
    held = state.select(F.col("source").alias("s"), "rest", F.col("below").alias("_below"), F.coalesce(prefix, F.lit(0)).alias("_prefix"), (F.col("finer_below").isNotNull() | (F.col("n") > 1)).alias("_split"))
    near = sized["source"].eqNullSafe(F.col("s")) & (F.shiftright(split, shift + LEVEL_BITS) == F.col("_prefix"))
    if split == "finer":
        near = near & (F.col("cell") == F.col("_below")) & F.col("_split")
    cells = sized.join(held, near).groupBy("s", "rest", F.shiftright(split, shift).alias("at")).agg(F.sum("size").alias("_mass"), F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("after", F.sum("_mass").over(running)).filter(F.col("after") > F.col("rest"))
    found = summed.groupBy("s").agg(F.min_by(F.struct("at", (F.col("after") - F.col("_mass")).alias("before"), "_mass", "_rows"), "at").alias("edge"))
    joined = state.join(found, state["source"].eqNullSafe(found["s"]), "left")
    edge = lambda field, otherwise: F.coalesce(F.col(f"edge.{field}"), otherwise)
    none = F.lit((1 << (CELL_BITS - shift)) - 1)
    if split == "finer":  # sources that are settled stay as they are
        made = {"rest": F.col("rest") - edge("before", F.lit(0)), prefix: F.col("edge.at"), "mass": edge("_mass", F.col("mass")), "n": edge("_rows", F.col("n"))}
    else:
        made = {"rest": F.col("rest") - edge("before", F.lit(0)), prefix: edge("at", none), "mass": edge("_mass", F.lit(0)), "n": edge("_rows", F.lit(0))}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in state.columns])


RESULTS = ("size", "source_size", "target", "taken")


def _timed(df: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """df's columns by place, with _size, _source_size, _target and _times (how often the mix takes the row)."""
    rows, (id_, source, text) = placed(df, id_col, source_col, text_col)
    cell = F.shiftright(row_hash(F.col(id_)), HASH_BITS - CELL_BITS)
    finer = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - CELL_BITS)
    rows = rows.withColumn("_size", word_count(F.col(text))).withColumn("_cell", cell).withColumn("_finer", finer)
    sized = cut(rows.select(F.col(source).alias("source"), F.col("_size").alias("size"), F.col("_cell").alias("cell"), F.col("_finer").alias("finer")))
    found = thresholds(sized, source_targets(sized, weights, share, most))
    limits = found.toDF("_of", "_source_size", "_target", "_whole", "_below", "_finer_below", "_number", "_n")
    held = rows.join(limits, F.col(source).eqNullSafe(F.col("_of")), "left")
    told = F.col("_finer_below").isNotNull()
    under = (F.col("_cell") < F.col("_below")) | ((F.col("_cell") == F.col("_below")) & told & (F.col("_finer") < F.col("_finer_below")))
    edge = (F.col("_cell") == F.col("_below")) & (~told | (F.col("_finer") == F.col("_finer_below")))
    held = held.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    if found.filter("n > 1").isEmpty():
        held = held.withColumn("_at", F.lit(0))
    else:
        # Equal rows on the edge are numbered by partition, so that many of them don't meet in one task.
        own = cut(held.filter("_edge").withColumn("_part", F.spark_partition_id()))
        before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        many = own.groupBy("_of", "_part").agg(F.count(F.lit(1)).alias("_many")).withColumn("_before", F.coalesce(F.sum("_many").over(before), F.lit(0)))
        many = many.select(F.col("_of").alias("_s"), F.col("_part").alias("_p"), "_before")
        local = F.row_number().over(Window.partitionBy("_of", "_part").orderBy("_cell")) - 1
        numbered = own.withColumn("_local", local).join(many, F.col("_of").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        held = held.filter("not _edge").withColumn("_at", F.lit(0).cast("long")).unionByName(numbered.withColumn("_at", F.col("_before") + F.col("_local")).drop("_part", "_local", "_s", "_p", "_before"))
    taken = F.when(F.col("_edge"), F.col("_at") < F.col("_number")).otherwise(under)
    return held.withColumn("_times", F.col("_whole") + F.coalesce(taken, F.lit(False)).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """df's rows with size, source_size, target and taken (words the mix takes of the row, repeats counted)."""
    found = _timed(df, id_col, source_col, text_col, weights, share, most)
    own = [(f"_c{i}", c) for i, c in enumerate(df.columns) if c.lower() not in RESULTS]
    rows = found.select(*[c for c, _ in own], "_size", "_source_size", "_target", F.col("_size") * F.col("_times"))
    return rows.toDF(*[name for _, name in own], *RESULTS)


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """df's own columns and rows as the mix has them: a row taken twice is there twice, one not taken, or without words,
    is gone."""
    found = _timed(df, id_col, source_col, text_col, weights, share, most).filter("_size > 0 and _times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))
    return found.withColumn("_copy", copies).select(*[f"_c{i}" for i in range(len(df.columns))]).toDF(*df.columns)
