"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of every text is joined by its hash to the positions of the templates (third words are
compared too), hits are counted by diagonal (place in the text less place in the template), diagonals up to `gap`
apart are merged, and a merged span counts if it covers enough of its template without being stretched. The base
phrases are templates of one position.

Defined results: a null or empty text has no words, no places and score 0; long texts are scanned whole; texts are keyed
by id and hash, so repeated rows and null ids give repeated results; templates that overlap or tie each give their label;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import picked

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Openings of well-known licenses and notices, in words as the scan sees them, and their labels; NOTICES are added below.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_CC = {"": "", "-sa": " sharealike", "-nc": " noncommercial", "-nd": " noderivatives", "-nc-sa": " noncommercial sharealike", "-nc-nd": " noncommercial noderivatives"}
_APART = {"sharealike": "share alike", "noncommercial": "non commercial", "noderivatives": "no derivatives"}

#: Names of licenses as short notices give them ("released under the ..."), and their labels.
NAMES = (
    *(("mit", x) for x in ("mit license", "expat license")),
    ("isc", "isc license"),
    *(("bsd", x) for x in ("bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "two clause bsd", "three clause bsd", "new bsd license", "modified bsd license", "revised bsd license", "simplified bsd license")),
    *((f"apache-{a}.{b}", f"apache {x}{a} {b}") for a, b in ("20", "11") for x in ("", "license ", "license version ")),
    ("apache-2.0", "apache license v2 0"),
    *((f"gpl-{v}.0", x + v) for v in "23" for x in ("gnu general public license version ", "gnu general public license v", "gnu gpl version ", "gnu gpl v", "gpl version ", "gpl v", "gplv")),
    *(("lgpl", x) for x in ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl")),
    *((f"lgpl-{label}", x + v) for label, v in (("2.1", "2 1"), ("3.0", "3")) for x in ("gnu lesser general public license version ", "gnu lesser general public license v", "gnu lgpl version ", "gnu lgpl v", "lgpl version ", "lgpl v", "lgplv")),
    *(("agpl-3.0", x) for x in ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agplv3")),
    *((f"mpl-{a}.{b}", f"{x}{a} {b}") for a, b in ("20", "11") for x in ("mozilla public license ", "mozilla public license version ", "mozilla public license v ", "mozilla public license v", "mpl ", "mpl version ", "mpl v")),
    *((f"cc-by{k}", f"cc by{k.replace('-', ' ')} {v}") for k in _CC for v in ("1 0", "2 0", "2 5", "3 0", "4 0")),
    *((f"cc-by{k}", f"creative commons attribution{x} {v}") for k, name in _CC.items() for x in {name, " ".join(_APART.get(w, w) for w in (" " + name.strip()).split(" "))} for v in ("1 0", "2 0", "2 5", "3 0", "4 0")),
    *(("cc0", x) for x in ("cc0 1 0", "creative commons zero")),
    *(("unlicense", x) for x in ("unlicense",)),
)

#: A notice has nine words at most: of seven positions all are asked, so that another version doesn't pass for it.
NOTICES = tuple(sorted({(label, " ".join(f"{lead} {name}".split()[-9:])) for label, name in NAMES for lead in ("under", "under the", "under a", "terms of the") if len(f"{lead} {name}".split()) > 2}))
TEMPLATES += NOTICES


#: Template positions up to which they are broadcast.
MOST_POSITIONS = 100_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_positions(spark, templates, base) -> DataFrame:
    """template, label, is_base, n (positions of the template), at, a, b, c: its words at a position, c null at the end
    of two-word phrases. A constant table of a few hundred rows."""
    rows = [(-1 - i, label, True, 1, 0, *(phrase.split() + [None])[:3]) for i, (phrase, label) in enumerate(base.items())]
    for i, (label, text) in enumerate(templates):
        w = text.split()
        rows += [(i, label, False, len(w) - 2, k, *w[k : k + 3]) for k in range(len(w) - 2)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, n int, at int, a string, b string, c string")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE_PHRASES, gap: int = 2, coverage: float = 0.87, stretch: float = 1.5) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of df.

    score: the largest covered share of a template among the accepted spans; a base phrase counts as covered whole.
    """
    texts = picked(df, id=id_col, text=text_col)
    keyed = texts.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("w"))
    grams = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("c"))
    rolled = keyed.select("id", "key", F.posexplode(grams).alias("pos", "g")).select("id", "key", "pos", F.xxhash64("g.a", "g.b").alias("pair"), F.col("g.a").alias("ga"), F.col("g.b").alias("gb"), F.col("g.c").alias("gc"))
    held = template_positions(df.sparkSession, templates, base).withColumn("pair", F.xxhash64("a", "b"))
    same = (F.col("ga") == F.col("a")) & (F.col("gb") == F.col("b")) & (F.col("c").isNull() | (F.col("gc") == F.col("c")))
    # The templates lie with the driver; many of them are joined as a table.
    rows = len(base) + sum(max(0, text.count(" ") - 1) for _, text in templates)
    hits = rolled.join(F.broadcast(held) if rows <= MOST_POSITIONS else held, "pair").filter(same)
    # One row per text and diagonal, so repeated rows of df count once and a text's hits are summed before the shuffle.
    votes = hits.groupBy("id", "key", "template", "label", "is_base", "n", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by_place = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1).over(by_place) > F.when(F.col("is_base"), 0).otherwise(gap)) | F.lag("diagonal", 1).over(by_place).isNull()
    runs = votes.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "key", "template", "label", "is_base", "n", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.col("covered") / F.col("n")
    accepted = spans.filter((share >= coverage) & (F.col("last") - F.col("first") + 1 <= stretch * F.col("n") + gap))
    found = accepted.groupBy("id", "key").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    left = keyed.select("id", "key", F.size("w").cast("long").alias("n_words")).alias("l")
    found = found.alias("r")
    joined = left.join(found, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.key") == F.col("r.key")), "left")
    none = F.lit("")
    return joined.select(
        F.col("l.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
