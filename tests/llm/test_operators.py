"""The operators against plain definitions on small inputs, with nulls, empty texts, ties, repeats and clashing columns."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bitslice, chat, decontaminate, langid, mainhtml, mixing, pq, quality, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string"
WORDS = "ash birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en", "ing"]) for _ in range(n))


def union_find(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


# -- toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = []
    for k in range(240):
        text = prose(k, 20) + ". " + prose(1000 + k, 15)
        if k % 4 == 0:
            text += f". the {['scum', 'idiot'][k % 8 // 4]}ens went {prose(2000 + k, 4)}"
        rows.append((text, int(k % 4 == 0)))
    return toxicity.train(spark.createDataFrame(rows, "text string, label int"))


def test_toxic_sentences_are_found(spark, toxic_model):
    rows = [(k, prose(5000 + k, 30) + ". " + ("a scumens here. " if k % 2 else "") + prose(6000 + k, 10), 9.0) for k in range(40)]
    rows += [(100, None, 1.0), (101, "", 1.0), (102, "...", 1.0), (1, rows[1][1], 9.0)]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), toxic_model).collect()
    assert len(found) == 44 and found[0].asDict().keys() >= {"score", "offending", "n_sentences"}
    for r in found:
        if r.doc_id >= 100:
            assert (r.score, r.offending) == (0.0, [])
        else:
            assert (r.score >= 0.7) == (r.doc_id % 2 == 1)
            assert all("scumens" in r.text[s.begin : s.end] for s in r.offending)
    assert len({r.score for r in found if r.doc_id == 1}) == 1


def test_toxicity_without_labels(spark):
    model = toxicity.train(spark.createDataFrame([], "text string, label int"))
    assert model.bias < 0 and not model.weights.any()
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_the_fit_keeps_no_texts_and_ignores_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 12)
    texts = [f"{prose(k % 40, 30)}. {prose(k, 8)}. " * 40 for k in range(120)]
    rows = [(t + ("a scum here. " if k % 4 == 0 else ""), int(k % 4 == 0)) for k, t in enumerate(texts)]
    tracemalloc.start()
    whole = toxicity._fit(iter(rows), 3, 0.6, 0.01, 3, piece=1 << 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(len(t.split()) for t in texts)
    cut = toxicity._fit(iter(rows), 3, 0.6, 0.01, 3, piece=1000)
    assert whole.bias == cut.bias and (whole.weights == cut.weights).all() and whole.weights.any()


# -- language


def test_languages(spark):
    words = {"aa": ["lorp", "gnar", "tilk"], "bb": ["shom", "quev", "wazz"]}
    rows = [(k, " ".join(random.Random(k).choice(words[g]) for _ in range(12)), g, "s") for k in range(60) for g in words]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs)
    more = [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", None, "s"), (903, "LORP Tilk gnar" * 2000, None, "s")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([*more, *rows[:6], rows[0]], DOCS), model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[900].score == 0 and all(got[k].lang_pred == got[k].lang for k in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_filters_contain_what_was_added():
    model = langid.Filters(["x", "y"], np.zeros((1 << 12, 1), np.uint64), 3)
    model.add(0, ["ab", "cd"])
    model.add(1, ["cd", "ef"])
    assert model.counts(model.masks(["ab", "cd", "ef"])).tolist() == [[1, 0], [1, 1], [0, 1]]


def test_no_languages(spark):
    model = langid.train(spark.createDataFrame([(1, "ab", None, "s")], DOCS))
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "ab", None, "s")], DOCS), model).collect()] == ["und"]


# -- SimHash


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
@pytest.mark.parametrize("block", [64, 1 << 18])
def test_bit_planes_find_all_pairs(radius, block):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(2)]
    prints = np.unique(np.concatenate([b ^ flips[0] ^ flips[1] for b in base]))
    got = {(int(a), int(b)) for i, j in bitslice.close_pairs(prints, prints, radius, True, block) for a, b in zip(i, j, strict=True)}
    n = len(prints)
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if np.bitwise_count(prints[a] ^ prints[b]) <= radius}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_keep_every_component(spark, bucket):
    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(p)
            p ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    own = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in own]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket).collect()
    at = {p: k for k, p in enumerate(signed)}
    pairs = [(a, b) for a in range(len(own)) for b in range(a) if (own[a] ^ own[b]).bit_count() <= 2]
    assert union_find(len(own), [(at[e.source], at[e.target]) for e in edges]) == union_find(len(own), pairs)
    assert all((own[at[e.source]] ^ own[at[e.target]]).bit_count() <= 50 for e in edges)


def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    long = prose(1, 400)
    texts = [long, long.upper(), long + "\n", prose(2, 90), None, "", "Étude à deux", "one", "ONE ", long.replace("oak", "Oak", 1), prose(3, 30)]
    rows = [(k, x, "en", "s") for k, x in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "one", "en", "s"), (None, prose(9, 9), "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.groups(docs.withColumn("fp", docs["source"])).collect()
    prints = [plain_simhash(x) for x in texts]
    root = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == root[r.doc_id]
    assert sorted((r.component_id is None, r.component_id) for r in got if r.doc_id is None) == [(False, 7), (True, None)]
    kept = simhash.representatives(docs)
    assert sorted(r.doc_id if r.doc_id is not None else 99 for r in kept.collect()) == sorted({*root, 99}) and kept.columns == docs.columns
    assert simhash.groups(docs.limit(0)).count() == 0


def test_near_copies_are_grouped(spark):
    rows = []
    for k in range(30):
        words = prose(100 + k, 120).split()
        other = words[:]
        for at in random.Random(k).sample(range(120), 1 + k % 2):  # 5 or 10 of 116 shingles
            other[at] = "changed"
        far = words[:60] + prose(900 + k, 60).split()
        rows += [(3 * k, " ".join(words), "en", "s"), (3 * k + 1, " ".join(other), "en", "s"), (3 * k + 2, " ".join(far), "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in simhash.groups(docs, near=0.8).collect()}
    assert got == {d: d - (d % 3 == 1) for d in got} and len(got) == 90


def test_near_copies_that_share_a_hot_passage(spark):
    rng = random.Random(8)

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passage, rows = fresh(55), []
    for _ in range(60):  # 51 of 66 shingles are the passage's; families of three by an edit at the end
        own = fresh(15)
        rows += [passage + own, passage + own[:9] + fresh(6), passage + own[:8] + fresh(7)]
    rows += [r[:] for r in rows[:2]]
    runs = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    n = len(rows)
    prints = [plain_simhash(" ".join(r)) for r in rows]
    alike = [(a, b) for a in range(n) for b in range(a) if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])]
    want = union_find(n, alike + [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    docs = spark.createDataFrame([(None if k == n - 1 else k, " ".join(r), "en", "s") for k, r in enumerate(rows)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.groups(docs, near=0.8).collect()}
    assert got == {None if k == n - 1 else k: want[k] for k in range(n)} and len(set(want)) < n - 60


def test_near_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for k in range(150):  # a few words of each are its own: some reach others, most do not
        words = base[:]
        for at in rng.sample(range(160), 2 + k % 3):
            words[at] = f"x{k}_{at}"
        rows.append(words)
    runs = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    n = len(rows)
    prints = [plain_simhash(" ".join(r)) for r in rows]
    alike = [(a, b) for a in range(n) for b in range(a) if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])]
    want = union_find(n, alike + [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    met, decide = [], simhash._alike

    def counted(*tables, **how):
        met.append(tables[-1].count())
        return decide(*tables, **how)

    monkeypatch.setattr(simhash, "_alike", counted)
    docs = spark.createDataFrame([(k, " ".join(r), "en", "s") for k, r in enumerate(rows)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.groups(docs, near=0.8).collect()}
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < n
    assert sum(met) < 10 * n


def test_blocks_of_a_bucket_meet_like_the_whole(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h in range(40):
        own = rng.integers(0, 2**63, 30 + h % 4).astype(np.uint64)
        own[: 25 + h % 3] = np.arange(25 + h % 3, dtype=np.uint64) * 977
        rows.append((7, h, len(own), h % 5, h % 6, simhash.parts_counts(own)))
    bucket = spark.createDataFrame(rows, "p long, h long, n int, i int, component long, z binary")
    every = {tuple(r) for r in simhash._unjoined(bucket, 0.6, best=False).collect()}
    assert every and every == {tuple(r) for r in simhash._unjoined(bucket, 0.6, best=False, block=7).collect()}
    assert every >= {tuple(r) for r in simhash._unjoined(bucket, 0.6, best=True, block=7).collect()}


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for n in (1, 5, 130, 700, 3000):
        base = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        for _ in range(20):
            x, y = (np.sort(rng.choice(base, rng.integers(1, len(base) + 1), replace=False)) for _ in range(2))
            shared = len(np.intersect1d(x, y))
            most = simhash.shared_at_most(simhash.sketch_of(x), simhash.sketch_of(y))
            assert shared <= most <= min(len(x), len(y))
    other = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    assert simhash.shared_at_most(simhash.sketch_of(base[:3000]), simhash.sketch_of(other)) < 0.8 * 3000
    assert simhash.shared_at_most(simhash.sketch_of(base[:0]), simhash.sketch_of(other)) == 0


def test_an_id_with_two_texts_keeps_one_row_of_each_group(spark):
    a, b, c = (prose(k, 60) for k in (301, 302, 303))
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (1, c, "en", "s"), (7, c, "en", "s"), (7, prose(304, 60), "en", "s"), (5, a, "en", "t")]
    kept = simhash.representatives(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b), (1, c), (7, prose(304, 60))])


# -- tokens


def test_token_counts_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("piece_bpe_32k.model")
    rng = random.Random(5)
    letters = " \n\r\t▁ab c;{}()é字\U0001f600<s>\0 the"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "  ", "\n", "<s> </s> <unk>", " a ", "x" * 5000, prose(1, 6000), prose(1, 6000)]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.token_counts(spark.createDataFrame([(x, "old") for x in [*texts, None]], "text string, n_tokens string"), path, remember=50).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (len(model.encode(r.text or "")), len((r.text or "").encode()))
        assert r.over_limit == (r.n_tokens > 4096)


# -- pages


def test_main_text(spark):
    head = "<html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body>"
    page = (
        head + "<nav><a href='/x'>Menu</a></nav><div class='ad'>Buy</div><article><h1>Big &amp;amp; small</h1><p>One <b>t</b>wo\n three<br>four"
        "<p>five<aside>side</aside><div class='comments'>hey</div><form>in</form></article><footer>end</footer>"
    )
    rows = [(1, "http://a.b/1", page), (2, None, None), (None, "http://a.b/2", ""), (1, "http://a.b/1", page), (3, "x", "plain < text &lt;p&gt;")]
    got = mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = Counter((r.page_id, r.text) for r in got)
    assert texts == {(1, "Big &amp; small One two three four five"): 2, (2, ""): 1, (None, ""): 1, (3, "plain < text <p>"): 1}
    assert all(r.n_chars == len(r.text) for r in got)


def test_repeated_runs_are_boilerplate(spark):
    shared = "<div>This site is run by a few friends of trees</div>"
    rows = [(k, f"https://www.h.org/{k}", f"<body>{shared}<p>{prose(k, 25)}</p>{shared}</body>") for k in range(4)]
    rows += [(7, "https://other.org/", f"<body>{shared}</body>"), (8, "http://www.h.org/copy", rows[0][2])]
    got = {r.page_id: r.text for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 8)] == [prose(k, 25) for k in (0, 1, 2, 3, 0)]
    assert got[7] == "This site is run by a few friends of trees"


def test_quoted_passages_stay_and_comments_are_no_article(spark):
    menu, quote = "<div>Trees of the world and where they grow now</div>", prose(77, 20)
    rows = [(k, f"https://www.q.org/{k}", f"<body>{menu}<p>{prose(200 + k, 30)}</p></body>") for k in range(40)]
    rows[3] = (3, rows[3][1], f"<body>{menu}<p>{quote}</p><p>{prose(203, 30)}</p></body>")
    rows[4] = (4, rows[4][1], f"<body>{menu}<p>{quote}</p><!-- <article > --><script>var a='<main>'</script></body>")
    got = {r.page_id: r.text for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: prose(200 + k, 30) for k in range(40)} | {3: f"{quote} {prose(203, 30)}", 4: quote}


def test_template_runs_come_from_suffix_arrays(spark):
    rng = random.Random(5)
    menu = "<div>one two three four five six seven eight</div>"
    htmls = [f"<body>{menu if k % 3 else ''}<p>{' '.join(rng.choice('abc') for _ in range(rng.randrange(30)))}</p></body>" for k in range(30)]
    rows = [(k, f"http://h{k % 2}.org/{k}", x) for k, x in enumerate([*htmls, htmls[0], htmls[2], ""])]
    want = set()
    for host in (0, 1):
        streams = {tuple(t for _, _, t in mainhtml.stream_of(mainhtml.blocks_of(x))) for k, _, x in rows if k % 2 == host}
        runs = Counter(h for s in streams for h in set(mainhtml.suffixes_of([(0, 0, t) for t in s], 6)))
        want |= {(f"h{host}.org", h) for h, n in runs.items() if n > 1 and n >= 0.1 * len(streams)}
        hashes, n = mainhtml.repeated_runs([list(s) for s in streams], 6)
        assert dict(zip(hashes, n.tolist(), strict=True)) == runs
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (300_000, 100):  # one shard a host, and several
        assert {tuple(r) for r in mainhtml.template_runs(pages, shard=shard).collect()} == want and len(want) > 4


# -- quality


def test_importance_weights_and_top(spark):
    good, junk = [prose(k, 40) for k in range(60)], ["!!! WIN $$$ now now"] * 20
    rows = [(k, x) for k, x in enumerate(good + junk)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.resample(docs, spark.createDataFrame([(x,) for x in good[:30]], "text string"), share=0.75).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 82 and by[200].log_weight == by[201].log_weight == 0.0
    assert min(by[k].log_weight for k in range(60)) > max(by[k].log_weight for k in range(60, 80))
    chosen = sorted((r.gumbel_key for r in got), reverse=True)[: sum(r.selected for r in got)]
    assert {r.gumbel_key for r in got if r.selected} == set(chosen) and sum(r.selected for r in got) == 62


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100])
def test_top_is_exact(spark, k):
    rows = [(i, float(random.Random(i).choice([1, 2, 3, 4.5, -7])) + i % 3) for i in range(100)]
    got = quality.top(spark.createDataFrame(rows, "i long, v double"), "v", ["i"], k, bins=4, few=5).collect()
    assert {r.i for r in got if r.selected} == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


# -- vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(160):
        x = rng.normal(size=10)
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows), (x + rng.normal(size=10) * 0.06).tolist(), k % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(30)]  # copies
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 10, 1), (n + 2, [1.0, None] * 5, 1), (n + 3, [float("nan")] * 10, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:4], 0), (n + 6, [], 0)]
    frame = spark.createDataFrame([*rows, *odd, (None, rows[0][1], 0)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pq.near_vectors(frame, tile=16, lists=9).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, b) for a in range(n) for b in range(a) if rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.98]
    degree, root = Counter(v for p in pairs for v in p), union_find(n, pairs)
    assert len(pairs) > 50
    for k in range(n):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (degree[k], root[k], root[k] == k)
    assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in odd) and not got[None].kept
    assert pq.near_vectors(frame.limit(0)).count() == 0


# -- decontamination


def test_windows_equal_brute_force(spark):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (3, "one two"), (4, None), (5, ""), (6, prose(50, 30)), (None, "x y")]
    near = prose(50, 30).split()
    near[-1] = "zebra"
    texts = [prose(60, 50) + " " + prose(50, 30).upper() + " " + prose(61, 9), "a " + " ".join(near) + " b", prose(62, 500), "so One\ttwo", None, "", prose(51, 12)]
    docs = spark.createDataFrame([(k, x, "old") for k, x in enumerate(texts)], "doc_id long, text string, matches string")
    frame = spark.createDataFrame(items, "item_id long, text string")

    def runs(w, size):
        return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))

    want = {}
    for d, text in enumerate(texts):
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if i is None or not v:
                continue
            size = min(5, len(v))
            for s in range(len(w) - len(v) + 1):
                a, b = runs(w[s : s + len(v)], size), runs(v, size)
                both = sum((a & b).values())
                value = both / (2 * sum(b.values()) - both)
                if value >= 0.8 and value > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (value, s)
    for size in (8_000_000, 40):  # one block of items, several
        got = {(r.doc_id, m.item_id): (m.similarity, m.first_word) for r in decontaminate.matches(docs, frame, block_chars=size).collect() for m in r.matches}
        assert got == want and (1, 1) in got
    assert all(r.matches == [] for r in decontaminate.matches(docs, frame.limit(0)).collect())


def test_windows_beyond_the_radius_are_found():
    rng, beyond = random.Random(4), 0
    for _ in range(400):
        item, tail = ([f"w{rng.randrange(10**9)}".encode() for _ in range(k)] for k in (34, 3))
        window = item[:31] + tail  # 27 of 33 shingles are shared
        index = decontaminate.Items([(1, b" ".join(item).decode())], 5, 15, 0.8)
        hashes = [decontaminate.shingles(decontaminate.word_hashes(w), 5) for w in (item, window)]
        prints = [decontaminate._prints(decontaminate._bits(h).sum(axis=0, dtype=np.int64)[None], 30)[0] for h in hashes]
        beyond += np.bitwise_count(prints[0] ^ prints[1]) > 15
        found = index.search(decontaminate.word_hashes(window))
        assert found == [{"item_id": 1, "similarity": 27 / 33, "first_word": 0, "last_word": 33}]
    assert beyond


def test_cut_items_and_items_without_id_are_found(spark):
    item = prose(70, 50)
    docs = spark.createDataFrame([(1, " ".join(item.split()[:-1])), (2, " ".join(item.split()[:25])), (3, f"so {prose(71, 9)} so")], "doc_id long, text string")
    items = spark.createDataFrame([(4, item), (None, prose(71, 9))], "item_id long, text string")
    got = {r.doc_id: [(m.item_id, m.similarity, m.first_word, m.last_word) for m in r.matches] for r in decontaminate.matches(docs, items).collect()}
    assert got == {1: [(4, 45 / 46, 0, 48)], 2: [], 3: [(None, 1.0, 1, 9)]}


# -- mixing


def test_rake_meets_the_margins(spark):
    rows = [(s, g, t, float(1 + (i * 7 + j * 3 + k * 11) % 13)) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame(rows, "s string, l string, t string, w double")
    out = mixing.rake(cells, ["s", "l", "t"], "w", [0.0, 1.0, 0.5], 30).collect()
    total = sum(r[3] for r in rows)
    for s in "abc":
        assert sum(r.fitted for r in out if r.s == s) == pytest.approx(total / 3)
    for g in "xy":
        assert sum(r.fitted for r in out if r.l == g) == pytest.approx(sum(r[3] for r in rows if r[1] == g))


def test_mix_spends_the_budget(spark):
    rows = [(k, prose(k, 5 + k % 40) + (" !!" if k % 9 == 0 else ""), ["en", "fr", None][k % 3], ["big", "big", "small"][k % 3 if k % 5 else 2]) for k in range(600)]
    rows += [(700, None, None, None), (701, "", "en", "big"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", topic string")
    got = mixing.mix(docs, share=0.4).collect()
    total = sum(r.n_tokens for r in got)
    assert len(got) == len(rows) and sum(r.n_tokens * r.probability for r in got) == pytest.approx(0.4 * total, rel=1e-6)
    assert sum(r.n_tokens for r in got if r.drawn) == pytest.approx(0.4 * total, rel=0.15)
    assert all(r.n_tokens == len((r.text or "").split()) and 0 <= r.probability <= 1 for r in got)
    assert len({(r.probability, r.drawn) for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_searches_texts_once(spark, capsys):
    docs = spark.createDataFrame([(1, prose(1, 9), "en", "big")], DOCS)
    found = mixing.mix(docs, columns=["doc_id"])
    found.explain()
    assert "RLIKE" not in capsys.readouterr().out and set(found.columns) == {"doc_id", "topic", "n_tokens", "probability", "drawn"}


# -- chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé\nyo"), (1, 3, "ann", None), (1, 3, None, "x")]
    rows += [(2, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(9)] + [(None, 1, "ann", "lost"), (3, 0, "system", "alone"), (2, 8, "bob", "t8")]
    got = chat.perspectives(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, offset string"), part_turns=4).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "bob")}
    for conv, speaker in {(r.conv_id, r.speaker) for r in got}:
        parts = sorted((r for r in got if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: r.part)
        own = sorted([(r[1], r[2] or "unknown", r[3] or "") for r in rows if r[0] == conv])
        names = {"system": "system", speaker: "assistant"}
        pieces = [f"<|im_start|>{names.get(r, 'user name=' + r)}\n{x}<|im_end|>\n" for _, r, x in own]
        assert "".join(p.rendered for p in parts) == "".join(pieces)
        at = 0
        masked = []
        for p in parts:
            assert p.offset == at
            at += len(p.rendered)
            masked += [p.rendered[m.begin : m.end] for m in p["mask"]]
        assert masked == [x + "<|im_end|>" for _, r, x in own if r == speaker]


def test_order_of_shingles_counts_all_texts(spark):
    """A shingle of few texts goes late even if the sample for the order holds none of them."""
    rng = random.Random(12)
    passage, rows = " ".join(f"p{rng.randrange(10**9)}" for _ in range(24)), []
    for k in range(300):
        own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))
        rows.append((k, f"{passage} {own}" if k < 30 else own, "en", "s"))
    docs = spark.createDataFrame(rows, DOCS)
    runs = simhash._runs(5)
    common = simhash.common_shingles(docs.where("doc_id >= 30"), "text", 5)
    tables = simhash.often_shared(docs, "text", 5, chars=1000)
    shared = runs(passage)
    assert len(tables) == 2 and not np.isin(shared, common[0]).any() and all(simhash.has_slot(t, shared).all() for t in tables)
    for _, text, _, _ in rows[:30]:
        prefix = simhash.prefix_of(runs(text), *common, 0.8, tables)
        assert len(prefix) == 21 and not np.isin(shared, prefix).any()
    assert simhash.often_shared(docs, "text", 5) == []


@pytest.mark.parametrize("shard", [300_000, 120])
def test_article_template_is_what_most_articles_of_a_host_share(spark, shard):
    """Every page has an article: a plain count over all runs tells the template, in one shard and in several."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    share, quoted, rows = "share this story with all of your friends today", words(12), []
    for k in range(40):
        own = [words(20), words(15)]
        own += [share] if k % 2 == 0 and k != 38 else []  # host 0: 19 of 20 articles
        own += [quoted] if k % 10 == 1 else []  # host 1: four of 20
        body = "".join(f"<p>{x}</p>" for x in own)
        rows.append((k, f"http://h{k % 2}/{k}", f"<nav>menu {k}</nav><article>{body}</article>", " ".join(x for x in own if x != share)))
    rows += [(100 + k, "http://h0/copy", rows[1][2].replace("menu", "other"), rows[1][3]) for k in range(60)]  # equal articles are one
    rows += [(200 + k, "http://small/x", f"<article><p>{share}</p><p>own {k}</p></article>", f"{share} own {k}") for k in range(4)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = set()
    for host in ("h0", "h1", "small"):
        streams = {tuple(mainhtml.article_stream(mainhtml.blocks_of(x)).split(" ")) for _, u, x, _ in rows if f"//{host}/" in u}
        runs = Counter(h for s in streams for h in set(mainhtml.suffixes_of([(0, 0, t) for t in s], 6)))
        want |= {(host, h) for h, n in runs.items() if n >= 0.5 * len(streams) and n >= 5}
    found = mainhtml.article_runs(pages, shard=shard).select("host", F.explode("runs")).collect()
    assert sorted(map(tuple, found)) == sorted(want) and {h for h, _ in want} == {"h0"}
    assert {r.page_id: r.text for r in mainhtml.main_text(pages).collect()} == {r[0]: r[3] for r in rows}


def test_article_of_template_only_stays(spark):
    rows = [(k, "http://h/x", f"<article><p>one two three four five six seven</p>{f'<p>{prose(k, 9)}</p>' if k else ''}</article>") for k in range(8)]
    got = {r.page_id: r.text for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "one two three four five six seven"} | {k: prose(k, 9) for k in range(1, 8)}
