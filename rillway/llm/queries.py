"""The registered queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import bpe, secrets
from rillway.llm.imatch import imatch_edited
from rillway.llm.licenses import license_scan
from rillway.llm.line_dedup import line_dedup
from rillway.llm.mixing import mix
from rillway.llm.near_dedup import near_dedup
from rillway.llm.packing import pack
from rillway.llm.periodic import find_runs
from rillway.llm.quality import quality
from rillway.llm.suffix_dedup import suffix_dedup
from rillway.llm.turns import repair
from rillway.llm.url_filter import url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_edited(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("repeat_starts", "repeat_ends")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_dedup_005(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9, with the pipeline's ratio."""
    cut = line_dedup(table(spark, sf_dir, "documents"), ratio=0.05)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_dedup_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of raw pages by the host of their url."""
    cut = line_dedup(table(spark, sf_dir, "pages"), text_col="html", url_col="url")
    return cut.select("page_id", "n_lines", "n_dropped", F.sha2(F.coalesce("html", F.lit("")), 256).alias("html_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id")


def looped(docs: DataFrame) -> DataFrame:
    """documents where, by crc32 of the id, one in ten repeats the words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(looped(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, longer).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period AS exponent_milli"), "runs_sha256", "collapsed_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the faults that the query plants by crc32 of `conv_id:turn`."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    held = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    held = held.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return held.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("kind", "copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair(damaged(rows))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    done = done.select(F.col("conv_id").alias("own"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", text.alias("repaired"))
    every = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


# The columns of op4, op6, op7 and op8 that SQL can state, from the same queries.


def imatch_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_dedup": op2_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_imatch": op4_imatch,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_pack_sequences": op11_pack_sequences,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_turn_repair": op13_turn_repair,
    "line_dedup_005": line_dedup_005,
    "line_dedup_hosts": line_dedup_hosts,
    "imatch_base": imatch_base,
    "license_scan_base": license_scan_base,
    "quality_rules_base": quality_rules_base,
    "secret_scan_base": secret_scan_base,
}



def _edit(held: str, cost: int | str, edit: str) -> str:
    """SQL of a repair (nine digits of cost, then its audit) with one edit more."""
    return f"(printf('%09d', CAST(substr({held}, 1, 9) AS INTEGER) + {cost}) || substr({held}, 10) || '{edit}')"


ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) >> 24 AS cell FROM documents),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
        l AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, CAST(least(weight * coalesce((SELECT arg_min(level, source_size / weight) FROM l WHERE level * weight <= 2.0 * source_size), 1e300), 2.0 * source_size) AS DOUBLE) AS target FROM l),
        u AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
        c AS (SELECT source, cell, sum(size) AS mass FROM d GROUP BY source, cell),
        r AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(u.source_size AS BIGINT) AS source_size, u.target,
               CAST(d.size * (u.whole + CASE WHEN r.mass > 0 AND u.target - u.whole * u.source_size - r.before >= r.mass / 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.cell = d.cell""",
    "op3_url_filter": r"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        hits AS (SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
                 FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
        SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN hits USING (page_id)""",
    "op9_line_dedup": r"""
        WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
        total AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
        occ AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
        often AS (SELECT occ.source, line FROM occ JOIN total ON occ.source IS NOT DISTINCT FROM total.source
                  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY occ.source, line, total HAVING count(*) >= 5 AND count(*) > 0.1 * total),
        drops AS (SELECT source, list(line) AS drops FROM often GROUP BY source),
        cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept
                FROM documents LEFT JOIN drops ON documents.source IS NOT DISTINCT FROM drops.source)
        SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
               sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM cut""",
    "op13_turn_repair": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) + 1),
                       lambda i: CAST(ascii(substr(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), i, 1)) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda r, x: xor(r >> 1, 3988292384 * (r & 1))))) % 20 AS kind FROM conversations),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                     CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM d),
        r AS (SELECT *, substr(role, 1, 1) AS i, coalesce(fault IN ('blank', 'duplicate'), false) AS bad, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM f),
        -- nine digits of cost, then the audit, of the least repair so far at each place of the grammar: nothing yet, after s, after u, after a
        walk(conv_id, n, z, s, u, a) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', '900000000', '000000002I', '000000004II' FROM d
            UNION ALL
            SELECT conv_id, n, dz, ds, iu, least(da, """ + _edit("iu", 2, "I") + r""")
            FROM (SELECT *, least(du, """ + _edit("least(dz, ds, da)", 2, "I") + r""") AS iu
                  FROM (SELECT w.conv_id, r.n, """ + _edit("z", 3, "D") + r""" AS dz,
                               least(""" + _edit("s", 3, "D") + r""", CASE WHEN NOT bad AND i = 's' THEN """ + _edit("z", "t", "K") + r""" ELSE '900000000' END) AS ds,
                               least(""" + _edit("u", 3, "D") + r""", CASE WHEN bad THEN '900000000' WHEN i = 'u' THEN """ + _edit("least(z, s, a)", "t", "K") + r""" ELSE """ + _edit("least(z, s, a)", "2 + t", "R") + r""" END) AS du,
                               least(""" + _edit("a", 3, "D") + r""", CASE WHEN bad THEN '900000000' WHEN i = 'a' THEN """ + _edit("u", "t", "K") + r""" ELSE """ + _edit("u", "2 + t", "R") + r""" END) AS da
                        FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))),
        plan AS (SELECT conv_id, CAST(substr(arg_max(least(z, a), n), 1, 9) AS BIGINT) AS cost, substr(arg_max(least(z, a), n), 10) AS audit FROM walk GROUP BY conv_id),
        edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM plan),
        e AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(substr(audit, 1, j), 'I', '')) AS n, length(replace(substr(audit, 1, j), 'D', '')) AS place FROM edits),
        m AS (SELECT e.*, r.role, r.text, r.i, bool_or(edit = 'K' AND r.i = 's') OVER (PARTITION BY e.conv_id) AS system FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = e.n),
        made AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
                 FROM m WHERE edit <> 'D' GROUP BY conv_id),
        pairs AS (SELECT conv_id, i || lead(i) OVER (PARTITION BY conv_id ORDER BY n) AS pair FROM r),
        bad AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                          count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM r GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "imatch_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d)
        SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - half) || substr(next, 1, half)) AS edited_sha256 FROM n""",
    "license_scan_base": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        hits AS (SELECT doc_id, i - 1 AS place, 'cc-by' AS label FROM p WHERE w[i:i+1] = ['cc', 'by']
                 UNION ALL SELECT doc_id, i - 1, 'gpl' FROM p WHERE w[i:i+2] = ['general', 'public', 'license']
                 UNION ALL SELECT doc_id, i - 1, 'reserved' FROM p WHERE w[i:i+2] = ['all', 'rights', 'reserved']),
        found AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
        FROM d LEFT JOIN found USING (doc_id)""",
    "quality_rules_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d),
        again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) x(k) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
        FROM d LEFT JOIN covered USING (doc_id)""",
    "secret_scan_base": r"""
        SELECT doc_id,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
        FROM documents""",
}

ORACLE_SQL["line_dedup_005"] = ORACLE_SQL["op9_line_dedup"].replace("> 0.1 * total", "> 0.05 * total")
_HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
ORACLE_SQL["line_dedup_hosts"] = f"WITH documents AS (SELECT page_id AS doc_id, {_HOST} AS source, html AS text FROM pages), " + ORACLE_SQL["op9_line_dedup"].split("WITH ", 1)[1].replace("pages AS (SELECT", "own AS (SELECT").replace("FROM pages", "FROM own").replace("SELECT doc_id, CAST", "SELECT doc_id AS page_id, CAST").replace("AS text_sha256", "AS html_sha256")
