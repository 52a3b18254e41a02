"""Packing, periodic runs and conversation repair against plain versions, and at the edges."""

import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillway.llm import packing, periodic, queries, turns
from rillway.llm.common import text_bytes

EDGES = [None, "", " \n\t", "one", "a " * 40, "x y z " * 30 + "end", "word " * 3000, "a " * 40, "I'll 're don't 　 12 é中😀  "]


# -- packing ----------------------------------------------------------------------------------------------------------


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, texts, end_id=1):
    """Each row's id is its place in texts: pieces tile the documents and gapless sequences of a power of two."""
    want = [[*e.ids, end_id] for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    documents, sequences = {}, {}
    for r in rows:
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == struct.pack(f"<{len(own)}I", *own) and r["doc_tokens"] == len(want[r["doc_id"]])
        documents.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"], r["step_id"]))
    assert sorted(documents) == list(range(len(texts)))
    for doc, parts in documents.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == len(want[doc])
    for parts in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == parts[0][2] <= 2048 and at & (at - 1) == 0
        assert len({p[3] for p in parts}) == 1
    return sequences


def test_pack_edges(spark):
    texts = EDGES + ["<|endoftext", "tail of words " * 2000]
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    check_packed(packing.pack(df, queries.TOKENIZER).collect(), texts)
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(nulls, queries.TOKENIZER).collect()) == 2 * 3 + 1
    assert packing.pack(df.limit(0), queries.TOKENIZER).collect() == []
    with pytest.raises(ValueError, match="ids"):
        packing.pack(df.withColumnRenamed("doc_id", "ids"), queries.TOKENIZER, id_col="ids")
    with pytest.raises(ValueError, match="powers"):
        packing.pack(df, queries.TOKENIZER, tiers=(100,))


def test_pack_blocks_and_forgotten_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc d\n'é") for _ in range(rnd.randint(0, 3000))) for _ in range(60)]
    monkeypatch.setattr(packing, "KEPT_PIECES", 100)
    coder = packing.PieceIds(queries.TOKENIZER)
    import pyarrow as pa

    for part in (texts[:30], texts[30:]):
        ids, counts = coder.ids(*text_bytes(pa.array(part)))
        want = [e.ids for e in library().encode_batch(part, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
    assert len(coder.known) <= 100 or len(coder.known) == len(coder.counts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_packed(packing.pack(df, queries.TOKENIZER).collect(), texts)


def test_pieces_are_the_librarys():
    split = library().pre_tokenizer.pre_tokenize_str
    classes = packing.piece_ids(queries.TOKENIZER).classes
    rnd, letters = random.Random(3), "aab'''sstrevmlld  \n\t12!?é中　 -😀"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12)))
        flat = np.frombuffer(text.encode(), np.uint8)
        starts = packing.piece_starts(flat, np.array([0, len(flat)]), classes)
        assert starts.tolist() == [len(text[:a].encode()) for _, (a, _) in split(text)]
    every = "".join(f"A{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in [*range(0x3000), *range(0x1F000, 0x1F100)])
    flat = np.frombuffer(every.encode(), np.uint8)
    points = np.flatnonzero((flat & 0xC0) != 0x80)
    assert np.searchsorted(points, packing.piece_starts(flat, np.array([0, len(flat)]), classes)).tolist() == [a for _, (a, _) in split(every)]


def test_packer_tiers_and_steps():
    rnd = random.Random(5)
    for _ in range(100):
        lengths = [rnd.choice([1, 7, 300, rnd.randint(1, 6000)]) for _ in range(rnd.randint(1, 80))]
        made = packing.Packer(lengths)
        assert sum(made.windows) == sum(lengths) == sum(n for _, _, n, _, _ in made.rows)
        assert sum(w not in packing.TIERS for w in made.windows) <= 8
    lengths = [rnd.randint(1, 3000) for _ in range(2000)]
    made = packing.Packer(lengths)
    load = {}
    for window, step in zip(made.windows, made.steps(1 << 15), strict=True):
        load[step] = load.get(step, 0) + window
    assert max(load.values()) - min(load.values()) <= 2048 and len(load) == round(sum(lengths) / (1 << 15))
    # Few documents are cut: those over a window, and about one for each window's gap.
    assert len(made.rows) < len(lengths) + 2 * len(made.windows)


# -- periodic runs ----------------------------------------------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        same = [a == b for a, b in zip(words, words[q:], strict=False)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, q, length) for (start, length), q in found.items())


@pytest.mark.parametrize("kept", [4096, 10])
def test_runs_against_brute_force(monkeypatch, kept):
    monkeypatch.setattr(periodic, "KEPT_WORDS", kept)
    rnd = random.Random(6)
    for least, times in [(24, 3), (6, 3), (3, 3), (10, 2)]:
        periodic._kept_grid.cache_clear()
        for _ in range(25):
            texts = []
            for _ in range(rnd.randint(1, 10)):
                n, k = rnd.choice([0, 1, 5, 30, 100, 250]), rnd.choice([1, 2, 3, 50])
                words = [rnd.randrange(k) for _ in range(n)]
                if n > 30:
                    a = rnd.randrange(n)
                    p = rnd.randint(1, max(1, (n - a) // 3))
                    words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                texts.append(words * rnd.choice([1, 1, 3]))
            text, start, length, q = periodic.periodic_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least, times)
            for i, words in enumerate(texts):
                own = text == i
                assert sorted(zip(start[own].tolist(), q[own].tolist(), length[own].tolist(), strict=True)) == plain_runs(words, least, times)
    periodic._kept_grid.cache_clear()


def test_extensions_are_exact():
    rnd = random.Random(8)
    words = [rnd.randrange(2) for _ in range(60)] * 3 + [5] * 40
    line = np.array([0, *[w + 1 for w in words], 0])
    rounds = periodic.recompress(line, 7)
    x, y = np.triu_indices(len(words), 1)
    found = periodic.extensions(rounds, x + 1, y + 1)
    for a, b, n in zip(x.tolist(), y.tolist(), found.tolist(), strict=True):
        want = 0
        while b + want < len(words) and words[a + want] == words[b + want]:
            want += 1
        assert n == want


def test_find_runs_edges(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGES)], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in periodic.find_runs(df).collect()}
    for i, t in enumerate(EDGES):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        dropped = {k for s, q, n in runs for k in range(s + q, s + n)}
        assert [(r["start"], r["period"], r["length"]) for r in got[i]["runs"]] == runs
        assert got[i]["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in dropped) and got[i]["n_words"] == len(words)
    assert periodic.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="runs"):
        periodic.find_runs(df, id_col="runs")


def test_op12_against_plain(spark):
    """The query's own damage, digests and best run, on the smallest tables."""
    where, some = "/root/testdata/sf0.001", 0
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, where).collect()}
    for r in spark.read.parquet(f"{where}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if n > 1500:
            continue  # the plain version is too slow; the query had them
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        some += bool(runs)
        start, q, length = max(runs, key=lambda x: (Fraction(x[2], x[1]), -x[0], -x[1])) if runs else (None,) * 3
        dropped = {k for s, p, m in runs for k in range(s + p, s + m)}
        lines = "".join(f"{s},{m},{p}\n" for s, p, m in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        want = (len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want
    assert some > 10


# -- conversations ----------------------------------------------------------------------------------------------------


def plain_repair(codes):
    """(cost, audit) by trying all edits turn after turn at each place of the grammar."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(3):
            for place, (cost, audit) in list(best.items()):
                to, made = follows[place], (cost + 2, audit + "I")
                best[to] = min(best.get(to, made), made)
        return best

    best = with_inserts({"": (0, "")})
    for code in codes:
        new, extra = {}, int(code.isupper())
        for place, (cost, audit) in best.items():
            options = [(place, cost + 3, "D")]
            if code != "d":
                to = follows[place]
                options.append((to, cost + extra, "K") if code.lower() == to else (to, cost + extra + 2, "R"))
                if code.lower() == "s" and place == "":
                    options.append(("s", cost + extra, "K"))
            for to, c, edit in options:
                made = (c, audit + edit)
                new[to] = min(new.get(to, made), made)
        best = with_inserts(new)
    return min(x for place, x in best.items() if place in ("", "a"))


@pytest.mark.parametrize("block", [512, 1, 3, 7])
def test_align_against_all_edits(monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rnd = random.Random(9)
    for _ in range(600):
        codes = "".join(rnd.choice("uuuaaasodUASO") for _ in range(rnd.randint(0, 14)))
        assert turns.align(codes) == plain_repair(codes)
    codes = "".join("ua"[i % 2] if rnd.random() < 0.8 else rnd.choice("uasod") for i in range(1500))
    assert turns.align(codes) == plain_repair(codes)


def test_repair_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, None, None, None),
        (1, 3, "assistant", "Yes."), (1, 1, "user", "Ok?"), (1, 7, "assistant", "Yes."), (1, 7, "user", "no end"),
        (2, 0, "system", "Be good."), (3, 0, "user", "\n \t"), (4, 5, "tool", "x."), (4, 6, "", "y!"),
        (5, 1, "user", "Long. " * 20000), (5, 2, "assistant", "Done."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, cost string")
    got = {r["conv_id"]: r for r in turns.repair(df).collect()}
    shown = lambda c: [tuple(x) for x in got[c]["repaired"]]
    assert (got[None]["blank"], got[None]["gaps"], got[None]["audit"], got[None]["cost"]) == (2, 0, "DDKI", 8)
    assert shown(None) == [("user", "Hi."), ("assistant", "")]
    assert (got[1]["gaps"], got[1]["duplicate"], got[1]["truncated"], got[1]["illegal"]) == (4, 1, 1, 1)
    assert (got[1]["cost"], got[1]["audit"]) == (6, "KKDD") and shown(1) == [("user", "Ok?"), ("assistant", "Yes.")]
    assert (got[2]["cost"], got[2]["audit"], shown(2)) == (3, "D", [])
    assert (got[3]["blank"], got[3]["cost"], got[3]["audit"]) == (1, 3, "D")
    assert (got[4]["illegal"], got[4]["cost"], got[4]["audit"]) == (1, 4, "RR") and shown(4) == [("user", "x."), ("assistant", "y!")]
    assert (got[5]["cost"], got[5]["audit"]) == (0, "KK")
    assert turns.repair(df.limit(0)).collect() == []


def test_op13_lists_conversations_that_lost_all_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {gone, None}
    assert (got[gone]["cost"], got[gone]["audit"], got[gone]["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
