"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from test_llm_operators import WORD, brute_classes, brute_quality, brute_targets

import corpus_pipeline as P
from rillway.llm import bpe

SF = "/root/testdata/sf0.001"


def longest_repeat(text):
    """Most words that two suffixes of the text's words share."""
    w = WORD.findall(text)
    order = sorted(range(len(w)), key=lambda i: w[i:])
    best = 0
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        best = max(best, n)
    return best if best >= 8 else 0


def passes(text):
    n, _, _, _, repeated = brute_quality(text)
    longest = longest_repeat(text or "")
    return n >= 20 and 100 * repeated <= 30 * n and not (longest > 100 and 100 * longest > 20 * n)


def test_stages(spark):
    """On the documents of up to 1,500 words (only for the plain versions' sake)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("size(split(coalesce(text, ''), ' ')) <= 1500").cache()
    (_, rules), (_, lines), (_, near), (_, mix), (_, encode) = P.STAGES
    kept = rules(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if passes(r["text"])}

    cut = lines(spark, kept, SF).cache()
    pages = defaultdict(set)
    for r in kept.collect():
        pages[r["source"]].add(r["text"])
    drop = {}
    for site, texts in pages.items():
        n = Counter(x for t in texts for x in set(t.split("\n")) if WORD.search(x))
        drop[site] = {x for x, k in n.items() if k >= 5 and k > P.LINE_RATIO * len(texts)}
    wanted = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if x not in drop[r["source"]]) for r in kept.collect()}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    one = near(spark, cut, SF).cache()
    ordered = sorted(wanted)
    classes = brute_classes([wanted[i] for i in ordered])
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {ordered[i] for i in set(classes.values())}

    mixed = mix(spark, one, SF).cache()
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in one.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in one.collect():
        sizes[r["source"]] += size[r["doc_id"]]
    rows = mixed.collect()
    for r in rows:
        taken[r["source"]] += size[r["doc_id"]]
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in rows).values()) <= 2
    assert all(abs(taken[s] - t) <= max(size.values()) for s, t in brute_targets(sizes).items())

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(P.RANKS), special_tokens={})
    last = encode(spark, mixed, SF).collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in rows)
    for r in last:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["round_trip"] and r["n_tokens"] == len(ids) and r["ids"] == b"".join(i.to_bytes(4, "little") for i in ids)


def test_line_stage_drops_boilerplate_in_every_source(spark):
    """A line on 7 to 13 % of the pages goes in all sources, one on 2 to 4 % and those of single pages stay."""
    rows, often = [], "the line that all sources repeat"
    for s in range(7):
        for i in range(200):
            lines = [f"own {s} {i}"] + [often] * (i < 2 * (7 + s)) + [f"seldom {s}"] * (i < 5 + s % 4)
            rows.append((f"{s}-{i}", "\n".join(lines), "en", f"source {s}", 0))
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars int")
    found = {r["doc_id"]: r["text"] for r in P.line_stage(spark, docs, SF).collect()}
    assert found == {r[0]: "\n".join(x for x in r[1].split("\n") if x != often) for r in rows}
