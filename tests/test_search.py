import math
import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.operators import blocks
from lorekeep.operators import evaluate as EV
from lorekeep.operators import federation as FE
from lorekeep.operators import index as I
from lorekeep.operators import search as S
from lorekeep.sources import writers

NOTE = (
    "note_id string, title string, aliases array<string>, tags array<string>, summary string, retrieval_text string"
)


@pytest.fixture
def notes(rows):
    return rows(
        [
            ("n1", "Hallucination", ["confabulation"], ["ai"], "The model makes things up.", "wrong facts invented"),
            ("n2", "Retrieval", [], ["search"], "Finding the right notes.", "search index bm25 ranking"),
            ("n3", "RAG", [], ["search"], "Answers from retrieved notes.", "search then answer"),
        ],
        NOTE,
    )


@pytest.fixture
def asked(rows):
    return lambda *texts: rows(list(enumerate(texts)), "query_id long, text string")


def test_search_finds_and_ranks(notes, asked):
    got = S.search_index(asked("how does search ranking work", "model hallucinations"), notes, 2).collect()
    best = {r.query_id: r.note_id for r in got if r["rank"] == 1}
    assert best == {0: "n2", 1: "n1"}


def test_written_index_answers_like_the_notes(notes, asked, spark, tmp_path):
    writers.write_index(notes, str(tmp_path))
    blocks, corpus = writers.read_index(spark, str(tmp_path))
    queries = asked("search ranking", "wrong facts", "architettura dei retrieval")
    direct = S.search_index(queries, notes, 3).orderBy("query_id", "rank").collect()
    stored = S.search_index(queries, limit=3, blocks=blocks, corpus=corpus).orderBy("query_id", "rank").collect()
    assert direct == stored and direct


@pytest.mark.parametrize(("size", "chars"), [(1, 1_000_000), (7, 60)])
def test_blocks_skip_nothing_that_counts(rows, asked, spark, size, chars):
    rng = random.Random(size)
    words = ["search", "rank", "note", "idea", "perché", "graph", *[f"w{k}" for k in range(30)]]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([6, 36])]) for _ in range(n))
    from tests.test_temporal import note

    made = [note(f"n{k:03d}", text(3), summary=text(6), retrieval_text=text(rng.choice([0, 5, 40]))) for k in range(80)]
    df = rows([*made, *[note(f"copy{k}", *["w1 w2"], summary="w3", retrieval_text="search rank") for k in range(9)]], SC.NOTES)
    queries = asked(*[text(rng.randint(1, 8)) for _ in range(12)], "", "nothing like it", "search rank")
    corpus = I.corpus_row(df)
    how = {"scales": {"haystack": 1.0, "tri_title": 0.7, "tri_summary": 0.3}, "damping": 0.5}
    got = blocks.search_blocks(queries, blocks.build_blocks(df.coalesce(2), size), corpus, 4, chars=chars, **how)
    stats, postings = corpus.first(), I.build_postings(df).collect()
    df_of = Counter((p.field, p.term) for p in postings)
    want = []
    for q in query_terms(queries):
        raw, length = {}, {}
        for p in postings:
            if (p.field, p.term) in q.terms:
                idf = math.log(1 + (stats["n"] - df_of[p.field, p.term] + 0.5) / (df_of[p.field, p.term] + 0.5))
                own = raw.setdefault(p.note_id, Counter())
                own[p.field] += idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * max(p.dl, 1) / stats[p.field]))
                length[p.note_id] = p.hay_len
        top = {f: max((x[f] for x in raw.values()), default=0) for f in how["scales"]}
        mean = sum(length.values()) / len(length) if length else 0
        scored = []
        for n, x in raw.items():
            blend = sum(s * x[f] / top[f] for f, s in how["scales"].items() if top[f] > 0)
            value = blend * mean / (mean + 0.5 * length[n]) if mean > 0 else blend
            scored.append((-round(value, 9), n))
        want += [(q.query_id, n, rank) for rank, (_, n) in enumerate(sorted(scored)[:4], 1)]
    assert sorted((r.query_id, r.note_id, r["rank"]) for r in got.collect()) == sorted(want)
    listed = blocks.postings_of(blocks.build_blocks(df, size)).select("field", "term", "note_id", "tf", "dl", "hay_len")
    assert sorted(map(tuple, listed.collect())) == sorted((p.field, p.term, p.note_id, p.tf, p.dl, p.hay_len) for p in postings)


def query_terms(queries):
    found = {}
    for r in S.query_field_terms(queries).collect():
        found.setdefault(r.query_id, set()).add((r.field, r.term))
    return [SimpleNamespace(query_id=q, terms=t) for q, t in found.items()]


def test_passages_of_every_length_are_found(rows):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(60))) for k in range(25)] + [(90, ""), (91, "x")]
    passages = []
    for k, (_, text) in enumerate(docs[:25]):
        a = rng.randrange(len(text))
        passages.append((k, text[a : a + rng.choice([1, 4, 15, 40, 120])]))
    got = EV.verbatim_matches(rows(docs, "doc_id long, text string"), rows(passages, "query_id long, text string")).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == sorted((q, d) for q, p in passages for d, t in docs if p in t)
    assert EV.verbatim_matches(rows(docs, "doc_id long, text string"), rows([], "query_id long, text string")).count() == 0


def test_exact_name_needs_word_borders(notes, asked, rows):
    df = rows([("about dragons", "RAG"), ("what is RAG?", "RAG"), ("use c++ now", "c++")], "q string, t string")
    none = F.expr("cast(array() as array<string>)")
    assert [r[0] for r in df.select(S.exact_name(F.col("q"), F.col("t"), none)).collect()] == [False, True, False]


def test_rerank_breaks_ties_by_larger_title(rows, asked):
    hits = rows([(0, "A", 2.0), (0, "B", 2.0), (0, "C", 1.0)], "query_id long, title string, score double")
    names = rows([(0, "C", ["target"])], "query_id long, title string, aliases array<string>")
    got = S.rerank(asked("the target word"), None, hits, names, 3).orderBy("rank").collect()
    assert [(r.title, r.score) for r in got] == [("C", 1.0), ("B", 1.0), ("A", 1.0)]


def test_repeated_query_terms_count_twice(rows, asked):
    docs = rows([("d1", "alpha beta"), ("d2", "gamma delta")], "doc_id string, text string")
    once = S.bm25_search(asked("alpha"), docs).first().score
    twice = S.bm25_search(asked("alpha alpha"), docs).first().score
    assert twice == pytest.approx(2 * once, abs=1e-3)
    assert once == pytest.approx(math.log(1 + 1.5 / 1.5), abs=1e-3)


def test_substring_counts_do_not_overlap(rows, asked):
    docs = rows([("d1", "aaaa banana"), ("d2", "zzz")], "doc_id string, text string")
    got = S.substring_count_search(asked("aa an"), docs).collect()
    assert [(r.doc_id, r.score) for r in got] == [("d1", 4)]


def test_one_hop_prefers_typed_edges_and_keeps_seeds(rows):
    seeds = rows([(0, "A", 1), (0, "B", 2)], "query_id long, title string, rank int")
    edges = rows([("A", "related", "X"), ("A", "uses", "Y"), ("Z", "uses", "b"), ("A", "uses", "B")], "source string, type string, target string")
    got = S.expand_one_hop(seeds, edges, 4).orderBy("position").collect()
    assert [(r.title, r.route) for r in got] == [("A", "index"), ("B", "index"), ("Y", "graph"), ("X", "graph")]


def test_budget_keeps_a_prefix_or_the_head(rows):
    items = rows([(0, 1, "x" * 40), (0, 2, "y" * 400), (0, 3, "z" * 4), (1, 1, "w" * 100)], "query_id long, rank int, content string")
    got = S.fit_to_budget(items, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], len(r.content)) for r in got] == [(0, 1, 40), (1, 1, 80)]
    assert S.fit_to_budget(items, 0).count() == 0


def test_expansion_union_keeps_each_term_once(rows, asked):
    expansions = rows([("what is it", 0, "memory Graph"), ("what is it", 1, "graph index")], "cache_key string, pass int, expansion string")
    got = {r.query_id: r.text for r in S.expand_queries(asked("What  is it", "other"), expansions, 2).collect()}
    assert got == {0: "What is it memory Graph index", 1: "other"}
    one = {r.query_id: r.text for r in S.expand_queries(asked("What  is it", "other"), expansions).collect()}
    assert one == {0: "What  is it memory Graph", 1: "other"}


def test_triangulation_needs_agreement(rows):
    scores = rows([(0, "A", 1.0), (0, "B", 0.5)], "query_id long, title string, score double")
    edges = rows([("A", "uses", "X"), ("X", "uses", "B"), ("A", "uses", "Y")], "source string, type string, target string")
    got = {r.title: round(r.score, 3) for r in S.triangulate(scores, edges, 10, 0.4, 2).collect()}
    assert got == {"A": 1.0, "B": 0.5, "X": 0.6}


def test_metrics(rows):
    cases = rows([(1, "a"), (2, ""), (3, "a")], "query_id long, category string")
    run = rows([(1, " X ", 1), (1, "Y", 2), (2, "Q", 1)], "query_id long, title string, rank int")
    qrels = rows([(1, "y"), (1, "z"), (3, "x")], "query_id long, title string")
    per = EV.per_query(cases, run, qrels, 5, "title")
    got = {r.query_id: (r.negative, r.hit, r.recall, r.precision, r.reciprocal_rank) for r in per.collect()}
    assert got[1] == (False, 1, 0.5, 0.5, 0.5) and got[3] == (False, 0, 0.0, 0.0, 0.0) and got[2][0]
    total = EV.retrieval_metrics(per).first()
    assert (total.n, total.recall_at_k, total.mrr) == (2, 0.25, 0.25)
    assert EV.negative_rejection(per).first().negative_rejection == 0.0
    assert {r.category: r.n for r in EV.metrics_by_category(per).collect()} == {"a": 2, None: 2}


def test_ndcg_with_grades(rows):
    cases = rows([(1,), (2,)], "query_id long")
    run = rows([(1, "b", 1), (1, "a", 2)], "query_id long, doc_id string, rank int")
    qrels = rows([(1, "a", 2), (1, "b", 1)], "query_id long, doc_id string, grade int")
    got = {r.query_id: r.ndcg for r in EV.ndcg(cases, run, qrels, 2).collect()}
    assert got[1] == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3))) and got[2] == 0.0


def test_percentiles_pick_elements(rows):
    df = rows([("k", float(v)) for v in range(1, 101)], "k string, ms double")
    got = EV.latency_percentiles(df, ["k"]).first()
    assert (got.p50, got.p95, got.upper_p50, got.n_samples) == (50.5, 95.0, 51.0, 100)


def test_verbatim_matches_by_brute_force(rows):
    texts = {1: "one two three four five six", 2: "xone two three four fivex", 3: "a b", 4: "zz b"}
    parts = {1: "two three four five six", 2: "one two three four five", 3: "b", 4: "e two"}
    docs = rows(list(texts.items()), "doc_id long, text string")
    got = {(r.query_id, r.doc_id) for r in EV.verbatim_matches(docs, rows(list(parts.items()), "query_id long, text string")).collect()}
    assert got == {(q, d) for q, p in parts.items() for d, t in texts.items() if p in t}


@pytest.fixture
def federation(rows, notes):
    placed = notes.withColumn("collection_id", F.when(F.col("note_id") == "n1", "c1").when(F.col("note_id") == "n2", "c2").otherwise("c3"))
    cols = rows([("c1", "c1", "project", True, False), ("c2", "c2", "central", True, False), ("c3", "c3", "archive", True, True), ("c4", "c4", "project", True, False), ("c5", "c5", "project", False, False)],
                "collection_id string, name string, type string, federated boolean, sensitive boolean")
    return placed, cols


def test_federation_degrades_and_guards(federation, asked):
    placed, cols = federation
    built = FE.federate(placed, cols)
    assert {r.collection_id: r.skipped for r in built["report"].collect()}["c4"] == "missing"
    assert built["warnings"].count() == 1
    hidden = FE.federated_search(asked("search answer"), built["rows"], 5).collect()
    shown = FE.federated_search(asked("search answer"), built["rows"], 5, include_sensitive=True).collect()
    assert "c3::n3" not in {r.row_id for r in hidden} and "c3::n3" in {r.row_id for r in shown}


def test_stale_pointers_warn(federation, rows):
    placed, cols = federation
    built = FE.federate(placed, cols)["rows"]
    good, stale = FE.verify_pointers(built, placed.where("note_id <> 'n2'"))
    assert good.count() == 2 and "Retrieval" in stale.first().warning


def test_scopes(federation, asked):
    placed, cols = federation
    run = lambda policy: {(r.scope, r.title) for r in FE.scoped_search(asked("search wrong facts"), placed, cols, "c1", "c2", policy, 5).collect()}
    assert run("project-only") == {("[project]", "Hallucination")}
    assert run("central-only") == {("[central]", "Retrieval")}
    assert run("project+central") == {("[project]", "Hallucination"), ("[central]", "Retrieval")}
    assert {t for _, t in run("all")} == {"Hallucination", "Retrieval"}


def test_dense_search_is_exact_over_blocks(rows, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 1)
    vectors = rows([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    queries = rows([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in S.dense_search(queries, vectors, 2).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (1, 1): 4, (1, 2): 3}


def test_dense_search_by_blocks_and_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(-3, 4, (150, 6)).astype(float)
    data[5] = 0
    df = spark.createDataFrame([*[(k, v.tolist()) for k, v in enumerate(data)], (900, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(f"q{k}", data[k * 3].tolist()) for k in range(40)] + [("none", None)], "query_id string, vector array<double>")
    got = S.dense_search(asked, df, 4, block=7, tile=16).collect()
    norm = np.linalg.norm(data, axis=1)
    unit = data / np.where(norm == 0, 1, norm)[:, None]
    want = []
    for k in range(40):
        s = unit @ unit[k * 3]
        want += [(f"q{k}", int(v), rank) for rank, v in enumerate(np.lexsort((np.arange(150), -np.rint(s * 1e9)))[:4], 1)]
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == sorted(want)
    assert S.dense_search(asked.limit(0), df, 4).count() == 0 and S.dense_search(asked, df.limit(0), 4).count() == 0


def test_means_of_no_case_are_null(spark, tmp_path):
    import __spark_entry__ as entry

    def share(passage):
        place = f"{tmp_path}/{len(passage)}"
        spark.createDataFrame([(1, "alpha beta gamma", "en", "src0", 16)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        rejected, kept = (entry.queries()[q](spark, place).first() for q in ("negative_rejection", "retrieval_metrics"))
        return tuple(rejected), (kept.n, kept.mrr)

    assert share("alpha beta gamma") == ((0, None), (1, 1.0))
    assert share("delta") == ((1, 1.0), (0, None))


def test_postings_are_unpacked_in_slices_without_running_arrays(rows):
    notes = [(f"n{k}", f"title {k}", [], [], "sum", " ".join(f"word{w}" for w in range(k * 7)), []) for k in range(5)]
    df = rows(notes, "note_id string, title string, aliases array<string>, tags array<string>, summary string, retrieval_text string, body_sections array<struct<key:string,value:string>>")
    held = blocks.build_blocks(df, 3)
    found = blocks.postings_of(held, 4)
    assert "aggregate(" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, I.build_postings(df).select(*found.columns).collect()))


@pytest.mark.parametrize("decay", [0.1, 0.9])
def test_bounded_propagation_has_the_best_titles_with_whole_scores(rows, decay):
    rng = random.Random(4)
    scores = [(q, t, rng.random()) for q in range(6) for t in rng.sample(range(80), 40 if q else 3)]
    links = [(rng.randrange(90), "t", rng.randrange(90)) for _ in range(120)]
    hits, edges = rows(scores, "query_id long, title long, score double"), rows(links, "source long, type string, target long")
    best = lambda k: {
        (r.query_id, r.title, round(r.score, 9)) for r in S.topk(S.propagate_scores(hits, edges, decay, k), ["query_id"], [S.best("score"), F.asc("title")], 5).collect()
    }
    assert best(5) == best(None) and len(best(5)) == 30
    many, whole = (S.propagate_scores(hits, edges, 0.1, k).count() for k in (5, None))
    assert many < whole


def test_bounded_propagation_broadcasts_no_table_that_grows(rows):
    hits = rows([(q, t, (t + 1.0) / 9) for q in range(2) for t in range(9)], "query_id long, title long, score double")
    edges = rows([(t, "t", t + 1) for t in range(9)], "source long, type string, target long")
    found = S.propagate_scores(hits, edges, 0.4, 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.title, round(r.score, 6)) for r in found.where("title = 8").collect()} == {(q, 8, round(1 + 0.4 * 8 / 9, 6)) for q in range(2)}


def test_bounded_propagation_with_null_scores_and_titles(rows):
    hits = rows([(1, 1, None), (1, 2, 0.5), (1, None, 0.9), (1, 3, 0.4), (2, 4, None)], "query_id long, title long, score double")
    edges = rows([(1, "t", 2), (2, "t", 3), (None, "t", 3), (4, "t", 5)], "source long, type string, target long")
    best = lambda k: S.topk(S.propagate_scores(hits, edges, 0.4, k).where("title is not null"), ["query_id"], [S.best("score"), F.asc("title")], 2).collect()
    told = lambda k: {(r.query_id, r.title, r.score) for r in best(k) if r.score is not None}
    assert told(2) == told(None) != set()


def test_substring_counts_of_odd_rows(spark, rows, asked):
    """Blocks of queries, rows that share an id, null ids and texts, ties: as a plain count over the grouped rows."""
    texts = [(k, f"Aa b{'an' * (k % 4)} nana aab") for k in range(12)] + [(3, "aa aa"), (None, "aan"), (None, "xx aa"), (20, None), (21, "")]
    docs = rows(texts, "doc_id long, text string").repartition(3)
    queries = rows([(0, "aa an"), (1, "AN an nan"), (2, "zzz"), (3, "")], "query_id long, text string")
    want = []
    for q, text in queries.collect():
        score = {}
        for d, t in texts:
            score[d] = score.get(d, 0) + sum((t or "").lower().count(w) for w in text.lower().split())
        best = sorted((-s, d is not None, d or 0, d) for d, s in score.items() if s)[:5]
        want += [(q, d, n + 1, -s) for n, (s, _, _, d) in enumerate(best)]
    for chars in (1, 200_000):
        got = S.substring_count_search(queries, docs, 5, chars=chars).select("query_id", "doc_id", "rank", "score").collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[2])) == want


def test_keyword_scores_read_texts_before_they_rank(rows, asked, capsys):
    docs = rows([(1, "the bridge stands"), (1, "bridges"), (2, None), (3, "BRIDGE bridge of bridges"), (4, "")], "doc_id long, text string")
    queries = rows([(7, "bridge")], "query_id long, text string")
    for search in (S.bm25_search, S.term_overlap_search):
        found = search(queries, docs, 5)
        assert {r.doc_id for r in found.collect()} == {1, 3}
        found.explain()
        assert "regexp" not in capsys.readouterr().out


def test_shootout_runs_each_system_once(rows, spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(rank):
        met.add(1)
        return rank

    runs = rows([("a", 1, 10, 1), ("b", 1, 11, 1)], "system string, query_id long, doc_id long, rank int").withColumn("rank", seen("rank"))
    found = EV.shootout(runs, rows([(1,)], "query_id long"), rows([(1, 10, 1)], "query_id long, doc_id long, grade int"), 5)
    assert {r.system: r.recall_at_k for r in found.collect()} == {"a": 1.0, "b": 0.0} and met.value == 2


def test_passages_meet_documents_that_share_an_id(rows):
    docs = rows([(1, "one two three four five six")] * 2 + [(1, "one two")], "doc_id long, text string")
    found = EV.verbatim_matches(docs, rows([(5, "two three four five six")], "query_id long, text string"))
    assert [(r.query_id, r.doc_id) for r in found.collect()] == [(5, 1)] * 2
