"""Defined results at the edges: nulls, empty and very long texts, ties, repeated rows, clashing names, hash collisions."""

import math
import random
import re
import string
import struct
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from rillway.llm import bpe, imatch, licenses, mixing, near_dedup, periodic, quality, secrets, suffix_dedup, url_filter
from rillway.llm.common import exact_ids, spread_join
from rillway.llm.line_dedup import line_dedup
from rillway.llm.queries import ORACLE_SQL, RANKS, RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_ID", "SIZE", "N_Lines", "a.b", "key", "Block", "verdict", "_c0", "class_id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, and extra columns whose names clash."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6)))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", " \n", "one", "same text here of a few words\nsecond line", "same text here of a few words\nsecond line", long, " ".join(word() for _ in range(60)), None]
    ids = [None, None, 3, 4, 5, 5, 7, None, 3]
    rows = [(i, t, "en", s, 0, "x", 1, "y", 2, "z", "k", "b", "v", "c", 4) for i, t, s in zip(ids, texts, ["s", None, "s", "t", "t", "t", None, "s", "s"], strict=True)]
    kinds = ["long", "string", "string", "string", "long", "string", "long", "string", "long", "string", "string", "string", "string", "string", "long"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(COLUMNS, kinds, strict=True))).repartition(3)


OPERATORS = {
    "mix": mixing.mix,
    "near": near_dedup.near_dedup,
    "runs": periodic.find_runs,
    "url": lambda df: url_filter.url_filter(df, RULES, id_col="doc_id", url_col="text"),
    "url_join": lambda df: url_filter.url_filter(df, RULES, id_col="doc_id", url_col="text", max_bytes=0),
    "url_no_rules": lambda df: url_filter.url_filter(df, [], id_col="doc_id", url_col="text"),
    "imatch": imatch.imatch_edited,
    "bpe": lambda df: bpe.encode(df, RANKS, P.public_tokenizers.PATTERN, offsets=True, decoded=True),
    "licenses": licenses.license_scan,
    "quality": quality.quality,
    "secrets": secrets.find_secrets,
    "lines": line_dedup,
    "suffix": suffix_dedup.suffix_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_names(odd, name):
    found = OPERATORS[name](odd)
    assert found.count() == 9 and len(set(found.columns)) == len(found.columns)
    assert OPERATORS[name](odd.filter("false")).collect() == []


def test_stages_at_the_edges(spark, odd):
    """All but the last stage keep the columns of documents; short texts are rejected, other stages keep a row at least."""
    found = {}
    for name, stage in P.STAGES:
        rows = stage(spark, odd, "")
        assert name == P.STAGES[-1][0] or rows.columns == COLUMNS
        found[name] = rows.collect()
        assert stage(spark, odd.filter("false"), "").collect() == []
    id_, text, n_chars = 0, 1, 4
    assert sorted(len(r[text].split()) for r in found["quality_rules"]) == [60, 30_000]
    assert len(found["line_dedup"]) == 9 and all(r[n_chars] == (None if r[text] is None else len(r[text])) for r in found["line_dedup"])
    assert Counter(r[id_] for r in found["near_dedup"]) == {None: 2, 3: 2, 4: 1, 5: 1, 7: 1}
    assert len(found["byte_bpe"]) == 9 and all(r["round_trip"] for r in found["byte_bpe"])


# -- exact numbers


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_lines_and_words_that_polynomial_hashes_confuse(n):
    a, b = thue_morse(n)
    found = quality.measure(pa.array([f"{a}\n{b}", " ".join([a, b] * 8 + ["x"] + [b, a] * 8)]))
    assert found["n_dup_lines"].tolist() == [0, 0]
    assert found["n_words"].tolist() == [2, 33]


def test_exact_ids_without_a_hash(monkeypatch):
    """Equal numbers mean equal bytes even if all hashes collide."""
    monkeypatch.setattr("rillway.llm.common.word_hashes", lambda flat, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"ab", b"ba", b"ab", b"abc", b"", b"ba", b""]
    ends = np.cumsum([len(w) for w in words])
    ids = exact_ids(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert [[words[i] == words[j] for j in range(7)] for i in range(7)] == (ids[:, None] == ids[None]).tolist()


@pytest.mark.parametrize("window", [1, 5, 8, 10, 12])
def test_repeats_of_any_window(window):
    rnd = random.Random(window)
    texts = []
    for _ in range(120):
        few = rnd.choice(["ab", "abc", "abcdefghij"])
        head = [rnd.choice(few) for _ in range(rnd.randint(0, 50))]
        texts.append(" ".join(head + head[: rnd.randint(0, len(head))]))
    found = quality.measure(pa.array(texts), window)
    for i, t in enumerate(texts):
        w, covered, longest, repeats = WORD.findall(t), set(), 0, 0
        for size in range(window, len(w)):
            places = {}
            for k in range(len(w) - size + 1):
                places.setdefault(tuple(w[k : k + size]), []).append(k)
            for at in (p for p in places.values() if len(p) > 1):
                longest = size
                covered.update(k + j for k in at for j in range(size))
                before, after = {w[k - 1] if k else None for k in at}, {w[k + size] if k + size < len(w) else None for k in at}
                repeats += len(before) > 1 and len(after) > 1
        assert (found["n_repeat_words"][i], found["longest_repeat"][i], found["n_repeats"][i]) == (len(covered), longest, repeats)


# -- joins of crowded keys


def test_spread_join(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS k", "id AS v")
    right = spark.createDataFrame([(7, "hot"), (8, "cold"), (None, "none")], "k long, w string")
    plain = lambda how: sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)
    for how in ("inner", "left"):
        got = spread_join(left, right, "k", how, crowd=100, parts=8).select("k", "v", "w")
        assert sorted(map(tuple, got.collect()), key=str) == plain(how)


# -- I-Match


def test_imatch_against_python(spark):
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdeéß中") for _ in range(rnd.randint(1, 5))) for _ in range(200)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))) for _ in range(60)] + ["", "!!", "RARE words only Here", "word", None]
    texts += [texts[3], " ".join(reversed(texts[3].split()))]

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def fold(numbers):
        h = 42
        for x in numbers:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
        return h

    def terms(t):
        return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower()) if w}

    df = Counter(x for t in texts for x in terms(t))
    lexicon = {x for x, n in df.items() if max(2, 0.05 * len(texts)) <= n <= max(2, 0.5 * len(texts))}

    def prints(t):
        own = terms(t) & lexicon
        own = sorted(own if len(own) >= imatch.FEW else terms(t))
        whole = fold(own) if own else xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        subsets = {}
        for x in own:
            if x >= 0:
                subsets.setdefault(x >> 58, []).append(x)
        return f"{whole:x}".upper().lower(), {s: (s << 58) | (fold(x) >> 6) for s, x in subsets.items()}

    def near(a, b):
        either = a[1].keys() | b[1].keys()
        return sum(a[1].get(s) == b[1].get(s) for s in either) / len(either) if either else float(a[0] == b[0])

    for limit, block in ((100_000, 1 << 20), (3, 1000)):  # a listed and a joined lexicon, one block and many
        found = imatch.imatch_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), low=0.05, high=0.5, max_listed=limit, block_bytes=block)
        got = {r["doc_id"]: r for r in found.collect()}
        for i, t in enumerate(texts):
            t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
            half = len(t) // 2
            a, b, c = prints(t), prints(t[: len(t) - half] + nxt[:half]), prints(nxt)
            text = ".".join([a[0], ".".join(f"{x:x}" for _, x in sorted(a[1].items()))])
            assert got[i]["fingerprint"] == text
            assert (got[i]["near_edited"], got[i]["near_next"]) == (pytest.approx(near(a, b)), pytest.approx(near(a, c)))
    assert got[61]["fingerprint"] != got[60]["fingerprint"] and got[3]["fingerprint"] == got[65]["fingerprint"] == got[66]["fingerprint"]


def test_imatch_blocks_of_crowded_ids(spark):
    """Null ids and an id with a third of all rows are dealt over several blocks, in order."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 20) for i in range(600)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.xxhash64("text"))
    found = sorted(imatch.with_block(texts, 3000).select("id", "key", "block").collect(), key=lambda r: (r["id"] is not None, r["id"] or 0, r["key"]))
    assert [r["block"] for r in found] == sorted(r["block"] for r in found)
    sizes = Counter(r["block"] for r in found)
    assert len(sizes) > 20 and max(sizes.values()) < 80
    prints = imatch.imatch_edited(texts.select(F.col("id").alias("doc_id"), "text"), block_bytes=3000)
    assert prints.count() == 600 and prints.filter("near_next is null").count() == 0


# -- secrets


def test_battery_statistics():
    """Each test's p-value against a plain computation."""
    rnd = random.Random(3)
    tokens = ["".join(rnd.choice(a) for _ in range(n)) for a in (string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_letters + string.digits) for n in (20, 33, 150)] + ["a" * 30, "ab" * 20, "abcdefghijklmnopqrstuvwxyz"]
    flat, ends = np.frombuffer("".join(tokens).encode(), np.uint8), np.cumsum([len(t) for t in tokens])
    found = secrets.battery(flat, ends - [len(t) for t in tokens], ends)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for i, t in enumerate(tokens):
        which = next(k for k, a in enumerate(secrets.ALPHABETS) if set(t) <= set(a))
        alphabet, n = secrets.ALPHABETS[which], len(t)
        k = len(alphabet)
        chi = sum((t.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
        uniform = tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
        high = [alphabet.index(c) >= k / 2 for c in t]
        a, turns = sum(high), sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 2 * a * (n - a) / n
        runs = 2 * tail(abs(turns - mean) / math.sqrt(mean * (mean - 1) / (n - 1))) if mean > 1 else 2.0 ** (1 - n)
        x = [alphabet.index(c) for c in t]
        m = sum(x) / n
        power = sum((v - m) ** 2 for v in x)
        serial = 2 * tail(abs(sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False))) / power * math.sqrt(n)) if power else 0
        assert found["encoding"][i] == which
        assert [found[c][i] for c in ("uniform", "runs", "serial")] == [pytest.approx(v, rel=1e-6, abs=1e-12) for v in (uniform, runs, serial)]


def test_step_up_by_length():
    """Benjamini and Hochberg's rule, each stratum on its own."""
    cells = [(1, c, n) for c, n in ((0, 50), (3, 20), (9, 5), (20, 3))] + [(2, 0, 10), (2, 8, 1)]
    for q in (0.5, 0.05, 1e-3):
        wanted = {}
        for stratum in (1, 2):
            p = sorted(10 ** (-c / 4) for s, c, n in cells if s == stratum for _ in range(n))
            rejected = [x for i, x in enumerate(p, 1) if x <= q * i / len(p)]
            if rejected:
                wanted[stratum] = round(-4 * math.log10(max(rejected)))
        assert secrets.step_up(cells, q) == wanted


def test_random_tokens_are_found_and_long_words_are_not(spark):
    rnd = random.Random(6)
    syllables = ["on", "th", "tion", "er", "men", "te", "los", "ung", "heit", "ver", "lich", "eau", "que", "en"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    texts = [" ".join(word(rnd.randint(1, 4)) for _ in range(200)) for _ in range(100)]
    for i in range(40):
        texts[i] += f" {word(10)} end"
    planted = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (24, 32, 40, 64, 100)]
    texts += [f"see {p} there" for p in planted] + [f"see {'0123456789' * 4} and {'ab' * 20}"]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all([(s["start"], s["rank"], s["end"]) for s in found[100 + i]] == [(4, 3, 4 + len(p))] for i, p in enumerate(planted))
    assert all(not found[i] for i in range(100)) and not any(s["rank"] == 3 for s in found[105])


# -- lines


def test_lines_against_their_sql(spark):
    """Null texts are no pages; the query's SQL and the operator agree on them, on repeated rows and on null sites."""
    rows = [(i, f"own {i}\nhead" if i < 5 else f"own {i}" if i % 7 else None, ["s", None][i % 2], "en", 0) for i in range(100)] + [(200, "own 1\nhead", None, "en", 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    cut = line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    documents = docs.toPandas()  # noqa: F841
    wanted = duckdb.sql(ORACLE_SQL["op9_line_dedup"]).fetchall()
    assert sorted(map(tuple, cut.collect())) == sorted(wanted)


def test_lines_by_host(spark):
    rows = [(i, f"https://{'WWW.a.org' if i < 20 else 'b.org'}/p{i}?q", f"menu\npage {i}" if i < 20 else f"page {i}\n{'menu' if i == 30 else ''}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["html"] for r in line_dedup(pages, url_col="url", text_col="html").collect()}
    assert found == {i: f"page {i}" if i < 20 else html for i, _, html in rows}


# -- suffix dedup


@pytest.mark.parametrize("hot", [3, 20_000])
def test_passages_of_every_document(spark, hot):
    """A passage that all documents share, of null and repeated ids in many chunks, stays once."""
    rnd = random.Random(13)
    passage = "".join(rnd.choice(string.ascii_lowercase) for _ in range(300))
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"own {rnd.random()} {passage} end {rnd.random()}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = suffix_dedup.suffix_dedup(df.repartition(4), chunk_bytes=900, hot=hot)
    digest = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (1 << 64 if x >= 1 << 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    seen, wanted = set(), []
    for id_, t in order:
        b = t.encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        wanted.append((id_, len(b), sum(gone), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found.collect()), key=str) == sorted(wanted, key=str)
    assert sum(w[2] == 0 for w in wanted) == 1 and found.schema["doc_id"].dataType.simpleString() == "int"


def test_suffix_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        suffix_dedup.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# -- urls


def test_host_of_many_labels(spark):
    url = "http://" + "a." * 20_000 + "example.com/en/"
    found = url_filter.url_filter(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).first()
    assert (found["rule"], found["verdict"]) == ("example.com/en/", "block")


@pytest.mark.parametrize("ids", ["null", "rows"])
def test_mix_meets_its_targets_whatever_the_ids(spark, ids):
    """Sources with a third null ids, one id on half the rows, or many equal rows come within a document of their target."""
    rows = []
    for s in range(3):
        for i in range(900):
            key = None if ids == "null" and i % 3 == 0 else 7 if ids != "null" and i % 2 else 10_000 * s + i
            rows.append((key, f"s{s}", "same words in each row" if ids == "rows" and i % 2 else " ".join(["w"] * (i % 40)) + f" {i % 700}", i))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, cell int").repartition(5)
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "source", "text", "cell", *mixing.RESULTS] and got.count() == len(rows)
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 40 and r["most"] <= 2
    again = sorted(map(str, mixing.mix(df.repartition(3)).select("doc_id", "source", "text", "taken").collect()))
    assert again == sorted(map(str, got.select("doc_id", "source", "text", "taken").collect()))


def test_near_dedup_of_a_crowd_of_equal_rows(spark, monkeypatch):
    """Null ids and empty or equal texts by the hundred: one row stands for them, counts and classes stay."""
    monkeypatch.setattr(near_dedup, "CROWD", 5)
    words = [f"w{i}" for i in range(60)]
    edited = " ".join([*words[:30], "other", *words[31:]])
    rows = [(None, None)] * 40 + [(None, "")] * 30 + [(None, " ".join(words))] * 50 + [(7, " ".join(words))] * 20 + [(8, edited), (9, "alone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(df).groupBy("doc_id", "class_id", "class_rows").count().collect()
    assert {(r["doc_id"], r["class_id"], r["class_rows"], r["count"]) for r in got} == {(None, None, 40, 40), (None, None, 30, 30), (None, 7, 71, 50), (7, 7, 71, 20), (8, 7, 71, 1), (9, 9, 1, 1)}
    assert near_dedup.keep_one(df).count() == 4
