"""Periodic runs against a plain search of every period, and the digests of the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorekeep.llm import queries, runs


def plain_runs(w, least=12):
    """(start, length, period) of every maximal stretch with its smallest period, by the definition."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fast(values):
    return [(a, b - a, q) for a, b, q in runs.runs_of(np.array([*values, -1])).tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    for seed in range(250):
        rng = random.Random(seed * 10 + letters)
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 5)):  # periodic stretches, some broken by one word
            q, n, at = rng.randint(1, 14), rng.randint(5, 60), rng.randint(0, len(w))
            base = [rng.randrange(letters) for _ in range(q)]
            w[at:at] = [base[k % q] for k in range(n)]
        if w and seed % 3 == 0:
            w[rng.randrange(len(w))] = 99
        assert fast(w) == plain_runs(w), (letters, seed)


def test_structured_words_equal_brute_force():
    a, b = [0], [0, 1]
    for _ in range(8):
        a, b = b, b + a  # Fibonacci words are full of runs
    thue = [bin(k).count("1") % 2 for k in range(256)]
    shifted = [0, 1] * 20 + [1, 0] * 20 + [0] + [1, 0, 1] * 11
    for w in (b, thue, thue * 2, shifted, [3] * 200, [0] * 100 + [1] + [0] * 100, list(range(150)) * 2, list(range(100))):
        assert fast(w) == plain_runs(w)


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    values = rng.permutation(100)
    tree = runs.WaveletTree(values)
    low = rng.integers(0, 100, 500)
    high = np.minimum(100, low + rng.integers(0, 40, 500))
    x = rng.integers(0, 140, 500)
    got = tree.successor(low, high, x)
    for a, b, v, g in zip(low, high, x, got, strict=True):
        assert g == min([u for u in values[a:b] if u >= v], default=-1)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_equals_plain_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("aé xyz ") for _ in range(rng.randint(1, 160)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (None, "a b " * 9), (503, "w " * 5000), (504, "w " * 5000), (503, "w " * 5000)]
    rows += [(505, "\x1c".join("ab") + " \x1f\x85 " * 20), (506, "a b c d e f " * 2 + "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_clashing_columns_empty_tables_and_bad_bytes(spark):
    docs = spark.createDataFrame([(1, "x y " * 8, "clash", 2)], "doc_id long, body string, Runs string, n_words int")
    got = runs.periodic_runs(docs, text="body").collect()
    assert [(r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in got] == [(16, "x y", [(0, 16, 2)])]
    assert runs.periodic_runs(docs.limit(0), text="body").count() == 0
    bad = spark.range(1).selectExpr("id as doc_id", "cast(unhex('61FF62') as string) as text")
    assert runs.periodic_runs(bad).first().collapsed == "a�b"
