import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.operators import curation as CU
from lorekeep.operators import graph as G
from lorekeep.operators import ledger as LE
from lorekeep.operators import prompts as PR
from lorekeep.operators import skew
from lorekeep.operators import temporal as TM


def now():
    return F.lit("2026-07-01 09:00:00").cast("timestamp")

CLAIM = "claim_id string, note_id string, text string, valid_from timestamp, valid_to timestamp"


def day(n, month=1):
    return dt.datetime(2026, month, n)


def note(note_id, title, **over):
    base = dict(aliases=[], folder="", tags=[], summary=f"{title}.", retrieval_text=title, body_sections=[("content", title)],
                proposed_links=[], relations=[], sources=[("raw", "norm", "loc", "sha256:00", [])], confidence=0.8,
                created_at=day(1), updated_at=day(1))
    v = {**base, **over}
    return (note_id, title, v["aliases"], v["folder"], v["tags"], v["summary"], v["retrieval_text"], v["body_sections"], v["proposed_links"],
            v["relations"], v["sources"], v["confidence"], v["created_at"], v["updated_at"])


def test_two_level_running_values_equal_one_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.hash("id") % 100).alias("v"), F.lit(1).alias("one")
    )
    got = skew.running(df, ["k"], F.floor(F.col("o") / 37), [F.asc("o")], number="n", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lead={"nx": "v"})
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "o", "v", "one", F.row_number().over(w).alias("n"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.lead("v").over(w).alias("nx"))
    key = ["k", "o"]
    assert got.select(*want.columns).orderBy(*key).collect() == want.orderBy(*key).collect()


def test_claims_half_open_and_open_ended(rows):
    claims = rows([("c1", "n", "a", day(1), day(10)), ("c2", "n", "b", day(10), None), ("c3", "n", "c", None, day(5))], CLAIM)
    at = lambda n: {r.claim_id for r in TM.claims_as_of(claims, F.lit(day(n))).collect()}
    assert at(4) == {"c1", "c3"} and at(10) == {"c2"} and at(5) == {"c1"}
    assert [r.claim_id for r in TM.current_claims(claims).collect()] == ["c2"]


def test_undated_version_is_always_visible(rows):
    versions = rows([("n", None, 0, "old"), ("n", day(5), 1, "new")], "note_id string, updated_at timestamp, seq long, summary string")
    assert TM.note_as_of(versions, F.lit(day(1))).first().summary == "old"
    assert TM.note_as_of(versions, F.lit(day(6))).first().summary == "new"
    probes = rows([(1, "n", day(1)), (2, "n", day(5)), (3, "x", day(9))], "probe_id long, note_id string, t timestamp")
    got = {r.probe_id: r.summary for r in TM.asof_join(probes, versions).collect()}
    assert got == {1: "old", 2: "new", 3: None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30))
def test_version_times_grow_strictly(spark, ticks):
    df = spark.createDataFrame([("n", i, t) for i, t in enumerate(ticks)], "note_id string, seq long, t long")
    writes = df.select("note_id", "seq", F.timestamp_micros("t").alias("wrote_at"))
    times = [r.updated_at for r in TM.monotone_timestamps(writes).orderBy("seq").collect()]
    assert all(a < b for a, b in zip(times, times[1:], strict=False))
    assert all(t >= dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=k) for t, k in zip(times, ticks, strict=True))


def test_merge_prefers_strictly_higher_confidence(rows):
    old = rows([note("n", "Old", aliases=["a"], tags=["t"], retrieval_text="alpha", relations=[("Old", "uses", "X", 0.5)])], SC.NOTES)
    same = rows([(*note("n", "Same", aliases=["b", "a"], retrieval_text="alpha", relations=[("Old", "uses", "X", 0.9), ("Old", "uses", "Y", 0.9)]), 1)], SC.NOTES + ", seq int")
    got = CU.merge_notes(old, same).first()
    assert (got.title, got.aliases, got.retrieval_text, len(got.relations)) == ("Old", ["a", "b"], "alpha", 2)
    assert got.relations[0].confidence == 0.5
    better = rows([(*note("n", "Better", confidence=0.9, retrieval_text="beta", sources=[("r2", "n2", "l", "sha256:01", [])]), 1)], SC.NOTES + ", seq int")
    got = CU.merge_notes(old, better).first()
    assert (got.title, got.retrieval_text, got.confidence, len(got.sources)) == ("Better", "beta alpha", 0.9, 2)


def test_merge_folds_a_batch_in_order(rows):
    batch = rows([(*note("n", t, retrieval_text=x, confidence=c), i) for i, (t, x, c) in enumerate(
        [("A", "one", 0.5), ("B", "two", 0.7), ("C", "one", 0.6), ("D", "two three", 0.9)])], SC.NOTES + ", seq int")
    got = CU.merge_notes(batch.where("false").select(*batch.columns[:-1]), batch).first()
    assert (got.title, got.retrieval_text, got.confidence) == ("D", "two three two one", 0.9)


def test_upsert_keeps_creation_and_history(rows):
    current = rows([note("a", "A"), note("b", "B")], SC.NOTES)
    batch = rows([(*note("a", "A", summary="new", confidence=0.9), 0), (*note("c", "C"), 1)], SC.NOTES + ", seq int")
    out = TM.upsert_notes(current, batch, now())
    got = {r.note_id: r for r in out["notes"].collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].summary == "new"
    assert got["a"].created_at == day(1) and got["c"].created_at == dt.datetime(2026, 7, 1, 9)
    assert [r.note_id for r in out["history"].collect()] == ["a"]
    late = TM.overwrite_notes(rows([note("a", "A", updated_at=day(1, 9))], SC.NOTES), batch.where("note_id = 'a'"), now())["notes"].first()
    assert late.updated_at == day(1, 9) + dt.timedelta(microseconds=1)


def test_supersedes_refuses_unknown_and_self(rows):
    notes = rows([note("o", "Old"), note("n", "New", relations=[("New", "supersedes", "Gone", 0.9)])], SC.NOTES)
    states = TM.record_claims(rows([("o", "fact")], "note_id string, text string"), F.lit(day(1)))
    pairs = rows([("old", "NEW", "why"), ("Old", "old", ""), ("Nope", "New", "")], "old string, new string, evidence string")
    out = TM.record_supersedes(pairs, G.name_registry(notes), notes, states, now())
    assert {r.reason for r in out["rejected"].collect()} == {"a note cannot supersede itself", "note not found: Nope"}
    assert out["closed"].first().invalidated_by == "superseded by 'New'"
    assert out["markers"].first().text == "Superseded by 'New'"
    assert [(r.source, r.target) for r in out["relations"].collect()] == [("New", "Old")]


def test_correction_opens_and_closes_claims(rows):
    notes = rows([note("a", "A"), note("b", "B")], SC.NOTES)
    states = TM.record_claims(rows([("x", "none")], "note_id string, text string"), F.lit(day(1)))
    out = TM.apply_corrections(notes, rows([("a", "fixed", "body")], "title string, summary string, body string"), states, now())
    a = out["notes"].where("note_id = 'a'").first()
    assert a.summary == "fixed" and [s.key for s in a.body_sections] == ["content", "definizione"]
    assert out["opened"].first().valid_from == day(1) and out["closed"].first().invalidated_by == "correction"
    assert out["fresh"].first().text == "fixed" and out["notes"].count() == 2


def test_consolidate_absorbs_once_and_rewrites(rows):
    notes = rows([note("a", "A"), note("b", "B", relations=[("B", "uses", "C", 1.0)]), note("c", "C"), note("d", "D", relations=[("D", "uses", "B", 1.0), ("D", "uses", "A", 1.0)])], SC.NOTES)
    groups = rows([(0, "A", 0, "A"), (0, "A", 1, "B"), (1, "D", 0, "D"), (1, "D", 1, "B")], "group_seq long, canonical string, pos long, member string")
    kept, merged = CU.consolidate(notes, groups)
    got = {r.title: r for r in kept.collect()}
    assert set(got) == {"A", "C", "D"} and got["A"].aliases == ["B"] and merged.first().merged == 1
    assert [(r.target) for r in got["D"].relations] == ["A"] and got["A"].relations[0].target == "C"


def test_job_moves(rows):
    ev = rows([(1, day(1), 0, "queued"), (1, day(2), 1, "running"), (1, day(3), 2, "completed"), (1, day(4), 3, "running"), (2, day(1), 4, "running")],
              "job_id long, ts timestamp, seq long, state string")
    got = {r.seq: (r.previous, r.legal) for r in LE.transitions(ev).collect()}
    assert got == {0: (None, True), 1: ("queued", True), 2: ("running", True), 3: ("completed", False), 4: (None, False)}
    states = LE.job_state(ev)
    assert [r.job_id for r in LE.cancel(states, rows([(1,), (3,)], "job_id long")).collect()] == [1]


def test_reviews_decide_once(rows):
    added, bad = LE.add_reviews(rows([("correction", "t", '{"title":"A","summary":"s","body":"b"}'), ("nonsense", "x", "{}")], "kind string, title string, detail string"), now())
    assert bad.count() == 1
    item = added.first().item_id
    said = rows([(item, "applied", "")], "item_id string, decision string, reason string")
    events, late = LE.resolve_reviews(LE.review_state(added), said, now())
    state = LE.review_state(added.unionByName(events))
    assert state.first().resolution == "correction written" and late.count() == 0
    again, late = LE.resolve_reviews(state, said, now())
    assert again.count() == 0 and late.count() == 1
    assert LE.corrections_of(state).first().title == "A"


def test_provenance_priorities(rows):
    h = "ab" * 32
    src = lambda path, s: [(path, path + "#1", "l", s, [])]
    notes = rows([note("ok", "Ok", sources=src("r", "sha256:" + h[:16])), note("ch", "Ch", sources=src("r", "sha256:" + "cd" * 32)), note("lo", "Lo", sources=src("r", h), confidence=0.4),
                  note("no", "No", sources=[]), note("mi", "Mi", sources=src("gone", h)), note("sh", "Sh", sources=src("r", "sha256:short"))], SC.NOTES)
    got = {r.note_id: r.status for r in CU.provenance_status(notes, rows([("r", h)], "path string, text_hash string")).collect()}
    assert got == {"ok": "ok", "ch": "source_changed", "lo": "low_confidence", "no": "source_missing", "mi": "source_missing", "sh": "ok"}


def test_reindex_merge(rows):
    cached = rows([note("a", "A", tags=["x"]), note("z", "Z")], SC.NOTES)
    parsed = rows([("a", "A2", [], [], "", []), ("", "New One", [], ["t"], "sum", [])],
                  "id string, title string, aliases array<string>, tags array<string>, summary string, body_sections array<struct<key:string,value:string>>")
    merged, removed = CU.reindex_merge(parsed, cached)
    got = {r.note_id: r for r in merged.collect()}
    assert (got["a"].title, got["a"].tags, got["a"].summary) == ("A2", ["x"], "A.")
    assert got["new-one"].body_sections[0].value == "sum" and [r.note_id for r in removed.collect()] == ["z"]


def test_extractions_have_defaults_and_quarantine(rows):
    good = 'ok [{"title": "T", "relations": [{"target": "X"}, {"target": " "}], "proposed_links": [{"anchor": "a", "target": "Y"}, {"anchor": "", "target": "Z"}]}, {"title": ""}]'
    df = rows([(1, "r", "n", "l", "h", good), (2, "r", "n", "l", "h", "I cannot")], "chunk_id long, raw_path string, normalized_path string, locator string, source_hash string, answer string")
    notes, bad = PR.parse_extractions(df)
    n = notes.first()
    assert notes.count() == 1 and [r.chunk_id for r in bad.collect()] == [2]
    assert (n.note_id, n.summary, n.confidence, n.retrieval_text) == ("t", "T.", 0.8, "T")
    assert [(r.source, r.relation, r.target, r.confidence) for r in n.relations] == [("T", "related", "X", 0.5)]
    assert [p.target for p in n.proposed_links] == ["Y"] and n.body_sections[0].key == "summary"


def test_groups_verdicts_and_citations(rows):
    notes = rows([("A",), ("B",), ("C",)], "title string")
    out = PR.parse_groups(rows([(0, '[{"canonical": "Q", "members": ["B", "A", "x"]}, {"members": ["C"]}, {"canon')], "answer_id long, answer string"), notes).collect()
    assert [(r.canonical, r.member) for r in sorted(out, key=lambda r: r.pos)] == [("B", "B"), ("B", "A")]
    v = PR.parse_supersede_verdicts(rows([("o", "n", '{"supersedes": true, "confidence": 0.8}'), ("o2", "n2", '{"supersedes": true, "confidence": "?"}'), ("o3", "n3", "no")], "old_title string, new_title string, answer string"))
    assert v["applied"].first().old == "o" and v["reviews"].count() == 1
    cited = PR.check_citations(rows([(1, "see [1] and [7]")], "query_id long, answer string"), rows([(1, 1)], "query_id long, n int"))
    assert {(r.cited, r.known) for r in cited.collect()} == {(1, True), (7, False)}


def test_routing_by_id_then_name(rows):
    domains = rows([("dom-a", 0, "Alpha"), ("dom-b", 1, "Beta")], "domain_id string, domain_seq long, name string")
    members = rows([("dom-a", 0, "x"), ("dom-b", 0, "y")], "domain_id string, pos long, title string")
    answers = rows([(1, "DOM-A, dom-zz"), (2, "the beta one"), (3, "none")], "query_id long, answer string")
    got = {(r.query_id, r.title) for r in PR.route_members(answers, domains, members).collect()}
    assert got == {(1, "x"), (2, "y")}
    areas = rows([("area-1", "dom-b")], "area_id string, domain_id string")
    picked = rows([(1, "area-1"), (2, "area-9")], "query_id long, answer string")
    got = {(r.query_id, r.title) for r in PR.route_members(answers, domains, members, areas, picked).collect()}
    assert got == {(2, "y")}


def test_names_in_texts(rows):
    names = ["a", "bc", "alpha beta gamma", "alpha be", "ünï", "", "alpha beta gammb"]
    texts = ["say alpha beta gamma", "abc", "", "ünïcode", "xalpha bex", "none here: q"]
    found = PR.named_in(rows(list(enumerate(texts)), "query_id long, low string"), rows(list(enumerate(names)), "domain_id long, name string")).collect()
    assert sorted((r.query_id, r.domain_id) for r in found) == sorted((q, d) for q, t in enumerate(texts) for d, n in enumerate(names) if n and n in t)


def test_enrich_guard(rows):
    notes = rows([note("a", "A"), note("b", "B", retrieval_text="x ~symptoms: y"), note("c", "C")], SC.NOTES)
    said = rows([("a", " odd answers "), ("b", "more"), ("c", "bad {json}")], "id string, symptoms string")
    got = CU.enrich(notes, said).collect()
    assert [(r.note_id, r.retrieval_text) for r in got] == [("a", "A ~symptoms: odd answers")]


def test_groups_of_late_answers_fold_notes(rows):
    from lorekeep.operators import curation as CU
    from lorekeep.operators import prompts as PR

    notes = rows([note(t.lower(), t) for t in ("A", "B", "C", "D")], SC.NOTES)
    answer = '[{"canonical": "A", "members": ["A", "B"]}, {"canonical": "C", "members": ["C", "D", "B"]}]'
    groups = PR.parse_groups(rows([(9_000_000_000, answer)], "answer_id long, answer string"), notes)
    kept, _ = CU.consolidate(notes, groups)
    assert {r.title: sorted(r.aliases) for r in kept.collect()} == {"A": ["B"], "C": ["D"]}


def test_reviews_whose_hashes_begin_alike_stay_apart(spark, tmp_path):
    import __spark_entry__ as entry

    # the first eight digits of the hashes of these two items are equal
    spark.createDataFrame([(75350, 1, 0), (129290, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in entry.queries()["review_states"](spark, str(tmp_path)).collect()}
    assert got == {(75350, "applied"), (129290, "rejected")}


def test_conversations_of_one_text_are_parked_each(spark, tmp_path):
    import __spark_entry__ as entry

    turns = [(c, k, "user", f"t{k}") for c in (1, 2, 3) for k in range(6 if c < 3 else 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["parked_captures"](spark, str(tmp_path)).collect()
    assert {r.conv_id for r in got} == {1, 2} and len(got) == 2 and len({r.digest for r in got}) == 1


def test_listed_members_are_selected_without_the_whole_listing(spark, rows, monkeypatch):
    import random

    from lorekeep.operators import prompts as PR

    rng = random.Random(6)
    titles = [f"t{k}" for k in range(60)]
    listing = rows([(d, k, rng.choice(titles)) for d in "abc" for k in range(80)], "domain string, pos long, title string")
    routes = rows([(q, n, d) for q in range(8) for n, d in enumerate(rng.sample("abc", 1 + q % 3))], "query_id long, domain_seq int, domain string")
    found = rows([(q, t, n) for q in range(1, 9) for n, t in enumerate(rng.sample(titles + ["x", "y"], 5), 1)], "query_id long, title string, rank int")
    whole = routes.join(listing, "domain").select("query_id", "domain_seq", "pos", "title")
    want = sorted(map(tuple, PR.select_members(whole, found, 4).collect()))
    met, select = [], PR.select_members

    def counted(routed, *rest):
        met.append(routed.count())
        return select(routed, *rest)

    monkeypatch.setattr(PR, "select_members", counted)
    assert sorted(map(tuple, PR.select_listed(routes, listing, found, 4).collect())) == want and want
    assert met[0] <= routes.count() * (4 + 5 + 5) < whole.count()
