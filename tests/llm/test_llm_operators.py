"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillway.llm import bpe, imatch, licenses, mixing, near_dedup, quality, secrets, suffix_dedup, url_filter
from rillway.llm.line_dedup import line_dedup
from rillway.llm.queries import RANKS, RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß中") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ".", ",", "\n"]) for _ in range(n))
    out = [None, "", " \n ", "one", make(30), make(400), make(3000)]
    out += [make(rnd.randint(5, 120)) for _ in range(30)]
    out += [out[5], out[5], out[5][:900] + " edited " + out[5][900:], out[6] + "\n" + out[4], make(60) + out[5][200:700]]
    return out


# -- 1 mixing


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix(spark):
    rnd = random.Random(1)
    texts = [None, ""] + ["w " * rnd.randint(1, 60) for _ in range(1500)]
    sources = [rnd.choice([None, "a", "a", "a", "b", "ü", "z"]) for _ in texts]
    found = mixing.mix(docs(spark, texts, sources)).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    wanted, taken = brute_targets(sizes), defaultdict(int)
    for r in found:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 60 for s in wanted)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, texts, sources).repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in found}


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, ["x"]).filter("false")).collect() == []
    clash = docs(spark, ["a b", "c"]).withColumn("size", F.lit("x")).withColumn("taken", F.lit(1))
    assert {r["size"] for r in mixing.mix(clash).collect()} == {2, 1}
    rows = mixing.mixed(docs(spark, ["a b"] * 4, ["s", "s", "t", "t"]))
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows.count() == 6


# -- 2 near-dedup


def test_near_dedup_links(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(400)]

    def edited():
        out = list(base)
        for i in rnd.sample(range(0, 400, 7), 6):
            out[i] = word()
        return " ".join(out)

    texts = [" ".join(base)] + [edited() for _ in range(60)] + [" ".join(base)] * 5 + [" ".join(word() for _ in range(80)) for _ in range(40)] + [None, None, "", "!", "!", "two words", "Two WORDS."]
    found = near_dedup.near_dedup(docs(spark, texts)).collect()
    of = {r["doc_id"]: r["class_id"] for r in found}
    assert {of[i] for i in range(66)} == {0} and [of[i] for i in range(66, 106)] == list(range(66, 106))
    assert of[106] == of[107] == 106 and of[108] == 108 and of[109] == of[110] == 109 and of[111] == of[112] == 111
    assert sum(r["stays"] for r in found) == len(set(of.values()))
    kept = near_dedup.keep_one(docs(spark, texts).union(docs(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(of.values()))


def brute_classes(texts, threshold=0.8):
    """Least place of each text's class: all pairs' weighted Jaccard similarity by tf * idf, or by tf, closed."""
    words = [re.findall(r"[a-z0-9]+", t.lower()) for t in texts]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))) for w in words]
    df = Counter(s for bag in bags for s in bag)
    idf = {s: 1 + math.log((1 + len(texts)) / (1 + n)) for s, n in df.items()}
    root = list(range(len(texts)))
    for weigh in (lambda s, n: n * idf[s], lambda s, n: n):
        weighed = [{s: weigh(s, n) for s, n in bag.items()} for bag in bags]
        total = [sum(bag.values()) for bag in weighed]
        for i, a in enumerate(weighed):
            for j in range(i):
                least = sum(min(v, weighed[j][s]) for s, v in a.items() if s in weighed[j])
                if root[i] != root[j] and least and least / (total[i] + total[j] - least) >= threshold:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_near_dedup_shared_passage(spark):
    """Families around a passage that all their texts share, against all pairs' weighted Jaccard similarity."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for passage, both, own in ((360, 20, 36), (360, 34, 36), (360, 52, 36)):
        core = some(passage)
        for _ in range(100):
            pair = some(both)
            texts += [" ".join(core + pair + some(own)) for _ in range(2)]
    wanted = brute_classes(texts)
    assert 200 < len(set(wanted.values())) < 500
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs(spark, texts)).collect()} == wanted


def test_near_dedup_groups_edited_apart(spark):
    """Groups of texts with a few words changed in each, none of them the original: every pair of similarity 0.8 or more
    is in one class, and no class has more than those pairs close."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for _ in range(60):
            own = list(base)
            for i in rnd.sample(range(120), rnd.randint(1, 3)):
                own[i] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(rnd.randint(5, 200))) for _ in range(80)]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs(spark, texts)).collect()} == brute_classes(texts)


def test_keep_one_of_null_and_repeated_ids(spark):
    """One row of each class stays, although near texts have null ids or share one, or an id of another class's row."""
    rnd = random.Random(4)
    words = [["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200)] for _ in range(4)]
    near = lambda k, i: " ".join([*words[k][: 190 + i]])
    rows = [(None, near(0, 0)), (None, near(0, 5)), (None, near(0, 9)), (7, near(1, 0)), (7, near(1, 4)), (7, near(1, 9)), (1, near(2, 0)), (2, near(2, 5)), (1, near(3, 0)), (1, near(3, 0)), (None, near(3, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.keep_one(df).collect()
    assert sorted(words.index(next(w for w in words if r["text"].startswith(w[0]))) for r in kept) == [0, 1, 2, 3]
    assert {words.index(next(w for w in words if r["text"].startswith(w[0]))): r["doc_id"] for r in kept} == {0: None, 1: 7, 2: 1, 3: 1}
    assert sorted({r["class_rows"] for r in near_dedup.near_dedup(df).collect()}) == [2, 3]


def test_near_dedup_empty(spark):
    assert near_dedup.near_dedup(docs(spark, ["x"]).filter("false")).collect() == []
    lone = spark.createDataFrame([(None, None, 1)], "doc_id long, text string, key int")
    assert near_dedup.near_dedup(lone).first()["class_id"] is None


def test_weighted_jaccard_of_samples():
    import numpy as np

    rng = np.random.default_rng(0)
    value = rng.integers(0, 2**63, 600).astype(np.uint64)
    w = rng.uniform(0.5, 3, 600)
    a, b = slice(0, 500), slice(100, 600)
    codes = [list(near_dedup.weighted_samples(value[s], w[s], np.array([0]), 800)) for s in (a, b)]
    agree = np.mean([x[0] == y[0] for x, y in zip(*codes, strict=True)])
    assert agree == pytest.approx(w[100:500].sum() / w.sum(), abs=0.06)


# -- 3 url filter

URLS = [None, "", "no scheme", "http://EXAMPLE.com", "http://www.Example.com/en/1", "https://a.example.com/en/x?y#z", "https://x.net/es/", "ftp://net/fr/a#b", "http://notexample.com/en/", "http://com/", "x://y://z/en/", "http://example.com?q=/en/", "http://www.example.com/en/\nq", "http://net./es/"]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filter(spark, limit):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] * 2, "page_id long, url string, rule int")
    found = url_filter.url_filter(df, RULES, max_bytes=limit).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert tuple(r)[1:] == brute_url(URLS[r["page_id"]])


def test_url_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: 7)
    path = tmp_path / "rules"
    path.write_bytes(url_filter.pack(RULES))
    array = url_filter.DigestArray(str(path))
    hits = array.find([b"com/", b"net/fr/", b"other/"])
    assert [array.string(i) if i >= 0 else None for i in hits] == [b"com/", b"net/fr/", None]


# -- 4 I-Match


def test_imatch(spark, texts):
    found = {r["doc_id"]: r for r in imatch.imatch_edited(docs(spark, texts).repartition(5), low=0.01, high=0.9).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert found[37]["fingerprint"] == found[38]["fingerprint"] == found[5]["fingerprint"] and found[37]["near_next"] == 1.0
    assert found[5]["fingerprint"] != found[6]["fingerprint"]


def test_imatch_edges(spark):
    assert imatch.imatch_edited(docs(spark, ["x"]).filter("false")).collect() == []
    odd = spark.createDataFrame([(None, "a b", 0), (None, None, 0), (1, "c d e", 0), (1, "c d e", 0)], "doc_id long, text string, block int")
    assert sorted(r["n_chars"] for r in imatch.imatch_edited(odd).collect()) == [0, 3, 5, 5]


# -- 5 byte-level BPE


def test_bpe(spark, texts):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(3)
    marks = ["a", " ", "\t", "\r\n", "é", "\u0301", "\xa0", "'s", "'LL", "12", "½", "😀", "\u200d", "\x00", "\x85", "中", "<|endoftext|>", "_", "\x1c"]
    more = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["x" * 5000]
    df = docs(spark, texts + more)
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, offsets=True)
    back = {r["doc_id"]: r for r in bpe.decode(coded, RANKS, carry=("n_tokens", "ids", "starts", "ends")).collect()}
    for i, t in enumerate(texts + more):
        ids = library.encode_ordinary(t or "")
        assert back[i]["ids"] == b"".join(x.to_bytes(4, "little") for x in ids) and back[i]["n_tokens"] == len(ids)
        assert back[i]["decoded"] == (t or "").encode()
        for token, a, b in zip(ids, back[i]["starts"], back[i]["ends"], strict=True):
            assert library.decode_single_token_bytes(token) in (t[a:b]).encode()
    assert bpe.encode(df.filter("false"), RANKS, public_tokenizers.PATTERN).collect() == []


# -- 6 licenses


def test_licenses(spark, texts):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    more = ["CC-BY cc by All Rights reserved", "GNU General Public License general public license", f"x y {mit} z", "general public", "LICENSED under CC BY-NC 4.0.", "cc\x7fby ccé by"]
    every = texts + more
    found = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, every).union(docs(spark, every))).collect()}
    for i, t in enumerate(every):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(texts)
    assert found[n + 2]["labels"] == "mit" and 0.8 < found[n + 2]["score"] < 1 and found[n + 4]["labels"] == "cc-by,cc-by-nc"
    assert licenses.license_scan(docs(spark, ["x"]).filter("false")).collect() == []


def test_license_notices(spark):
    """Each short notice bears its label and no other license's; clean texts bear none."""
    wanted = {
        "Released under the MIT License.": "mit",
        "This code is distributed under the terms of the MIT license": "mit",
        "Licensed under the ISC License.": "isc",
        "Released under the BSD 3-Clause License.": "bsd",
        "Available under a BSD license": "bsd",
        "Released under the Apache License 2.0": "apache-2.0",
        "Released under the GNU General Public License v3": "gpl,gpl-3.0",
        "Released under the GPL, version 2": "gpl-2.0",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "gpl,lgpl,lgpl-2.1",
        "Licensed under the GNU Lesser General Public License, version 2.0.": "gpl,lgpl",
        "under the terms of the GNU Lesser General Public License version 3": "gpl,lgpl,lgpl-3.0",
        "Released under the GNU Affero General Public License version 3": "agpl-3.0,gpl",
        "Released under the Mozilla Public License, version 2.0.": "mpl-2.0",
        "Subject to the terms of the Mozilla Public License, v. 1.1": "mpl-1.1",
        "Shared under CC BY-SA 3.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-ND 2.5.": "cc-by,cc-by-nc-nd",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        "under a Creative Commons Attribution-Share Alike 3.0 Unported License": "cc-by-sa",
        "Released under CC0 1.0": "cc0",
        "Released under the Unlicense": "unlicense",
        "The MIT campus lies under the bridge; a license was released.": "",
        "Students of the MIT met under a lesser public arch, version 3.": "",
        "An apache helicopter flew under the clouds 2.0 times; creative commons of the mozilla.": "",
    }
    found = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, list(wanted))).collect()}
    assert {t: found[i]["labels"] for i, t in enumerate(wanted)} == wanted
    every = [notice for _, notice in licenses.NOTICES]
    found = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, every)).collect()}
    assert all(label in found[i]["labels"].split(",") and found[i]["score"] == 1 for i, (label, _) in enumerate(licenses.NOTICES))


# -- 7 quality


def brute_quality(t):
    w = WORD.findall(t or "")
    seen, covered = defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines, again = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, len(covered)


def test_quality(spark, texts):
    rnd = random.Random(0)
    more = []
    for _ in range(150):
        few = [rnd.choice(["é", "a", "#", "<c>", "\xa0", "\x85", "\x1c"]) + str(j) for j in range(rnd.randint(1, 5))]
        t = "".join(rnd.choice(few) + rnd.choice([" ", "  ", "\n", "\t"]) for _ in range(rnd.randint(0, 120)))
        more.append(t + t[len(t) // 3 :])
    every = texts + more
    found = {r["doc_id"]: r for r in quality.quality(docs(spark, every)).collect()}
    for i, t in enumerate(every):
        b, r = brute_quality(t), found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r["base_failed"] and r["kept"])
        assert sum(y - x for x, y in zip(r["repeat_starts"], r["repeat_ends"], strict=True)) == b[4]
    kept = quality.keep_good(docs(spark, every))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if r["kept"])
    assert quality.quality(docs(spark, ["x"]).filter("false")).collect() == []


def test_longest_repeat(spark):
    text = " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(40, 75))
    r = quality.quality(docs(spark, [text])).first()
    assert (r["longest_repeat"], r["n_repeat_words"], r["repeat_starts"], r["repeat_ends"]) == (35, 70, [40, 300], [75, 335])


# -- 8 secrets


def test_secrets(spark, texts):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = re.compile("(" + "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rnd = random.Random(4)
    bits = ["password", "PassWd", "api_key", "apikey", "Token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "deadbeefdeadbeef", "x.y-z/", "ſecret", "=="]
    every = texts + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(200)] + ["key Aq3kZ9xLp0mWv7RtYb2NcD5fGh8JsQ4eTu6X end", "internationalizationofwords-and-more-of-these"]
    found = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, every)).collect()}
    for i, t in enumerate(every):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        got = [(s["start"], s["rank"], s["end"]) for s in found[i]["base"]]
        assert got == sorted(base) and set(got) <= {(s["start"], s["rank"], s["end"]) for s in found[i]["spans"]}
    assert [s["rank"] for s in found[len(every) - 2]["spans"]] == [3] and found[len(every) - 1]["spans"] == []
    assert secrets.find_secrets(docs(spark, ["x"]).filter("false")).collect() == []


# -- 9 line dedup


def test_lines(spark):
    texts = [f"head\nown {i}\n\n{'rare' if i < 2 else 'foot'}" for i in range(10)] + ["head\nalone"] * 3 + [None, ""]
    sources = ["a"] * 10 + ["b"] * 3 + [None, None]
    found = {r["doc_id"]: r for r in line_dedup(docs(spark, texts, sources), ratio=0.3).collect()}
    assert found[0]["text"] == "own 0\n\nrare" and found[5]["text"] == "own 5\n" and (found[5]["n_lines"], found[5]["n_dropped"]) == (4, 2)
    assert found[10]["text"] == "head\nalone" and found[13]["text"] is None and found[14]["text"] == ""
    assert line_dedup(docs(spark, ["x"]).filter("false")).collect() == []


# -- 10 suffix dedup


def brute_cut(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, texts, hot):
    rnd = random.Random(6)
    few = ["ab", "é", "abc ", "\x00", "zz\n"]
    base = "".join(rnd.choice(few) for _ in range(300))
    more = ["a" * 700, "a" * 350]
    for _ in range(40):
        at = rnd.randrange(len(base))
        more.append("".join(rnd.choice(few) for _ in range(rnd.randint(0, 60))) + base[at : at + rnd.randint(0, 400)] + "".join(rnd.choice(few) for _ in range(rnd.randint(0, 60))))
    every = texts + more
    found = suffix_dedup.suffix_dedup(docs(spark, every).repartition(3), chunk_bytes=4000, hot=hot).collect()
    wanted = brute_cut(every, 100)
    assert len(found) == len(every)
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == wanted[r["doc_id"]]


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup(docs(spark, ["x"]).filter("false")).collect() == []
    odd = spark.createDataFrame([(None, "b" * 150 + "c"), (1, "b" * 150), (1, "b" * 150), (None, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.suffix_dedup(odd).collect()) == [0, 149, 150, 150]


def test_blind_trie_sorts():
    rnd = random.Random(8)
    for _ in range(200):
        keys = [rnd.getrandbits(24) >> rnd.randint(0, 24) for _ in range(rnd.randint(1, 40))]
        order = suffix_dedup.blind_order(keys, 24)
        assert [keys[i] for i in order] == sorted(keys)
