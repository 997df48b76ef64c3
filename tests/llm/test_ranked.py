"""Ranked search on the length-stratified index against the formula applied to every document."""

import random
import re
from collections import Counter
from math import floor, log

import pytest

from lorekeep.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    own = [(d, Counter(plain_terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    total, words = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c, n in own:
            m = 75 + 25 * n * total // words
            score = sum(
                floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


def key(row):
    return [(x is not None, x or 0) for x in row]


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "étude", "ÉTUDE", "x1", "42", "naïve", "a_b", "don't", *[f"w{k}" for k in range(60)]]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([8, 69])]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 3, 3, 10, 10, 40, 300]))) for k in range(300)]
    docs += [(k, docs[0][1]) for k in range(400, 480)]  # ties
    docs += [(500, None), (501, ""), (502, "... !"), (None, docs[3][1]), (None, docs[3][1]), (7, docs[9][1]), (7, docs[9][1]), (503, "the " * 20_000)]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere found"), (93, docs[0][1]), (93, docs[0][1]), (93, "of of of x1"), (None, "42"), (94, "THE\x00étude\x7fof")]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "chars", "k"), [(1, 250_000, 1_000_000, 20), (2, 50, 1200, 5)])
def test_ranks_equal_the_formula(spark, seed, block, chars, k):
    docs, items = corpus(seed)
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as m", "2 as shard", "3 as n"), block=block)
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 as doc_id"), k=k, chars=chars).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items, k), key=key)


def test_blocks_hold_every_posting(spark):
    docs, _ = corpus(3)
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string"), block=200)
    own = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    total, words = len(own), sum(sum(c.values()) for _, c in own)
    want = Counter((75 + 25 * sum(c.values()) * total // words, d, t, n) for d, c in own for t, n in c.items())
    got = Counter()
    for b in index.blocks.collect():
        run = place = 0
        for term, runs in zip(b.terms, b.runs, strict=True):
            frequencies = b.run_tf[run : run + runs]
            assert frequencies == sorted(set(frequencies), reverse=True)
            for tf, n in zip(frequencies, b.run_n[run : run + runs], strict=True):
                got.update((b.m, b.docs[p], bytes(term).decode(), tf) for p in b.places[place : place + n])
                place += n
            run += runs
    assert got == want and (index.documents, index.terms) == (total, words)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert ranked.search(ranked.build(none), items).count() == 0
    one = ranked.build(spark.createDataFrame([(1, "b")], "doc_id long, text string"))
    assert ranked.search(one, items).count() == 0 and ranked.search(one, items.limit(0)).schema.names == ["item_id", "rank", "doc_id", "score"]
    bad = ranked.build(spark.range(1).selectExpr("id as doc_id", "cast(unhex('61FF62') as string) as text"))
    assert ranked.search(bad, spark.createDataFrame([("i", "a�b")], "item_id string, text string")).count() == 1
