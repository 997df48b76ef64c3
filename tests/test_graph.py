import random

from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import ontology as ON
from lorekeep.operators import skew
from lorekeep.operators import temporal as TM

EDGE = "source string, type string, target string"
TYPE = (
    "seq int, type_id string, name string, status string, inverse_of string, transitive boolean, "
    "symmetric boolean, surfaces array<string>"
)


def _types(rows, *specs):
    base = dict(status="active", inverse_of="", transitive=False, symmetric=False, surfaces=[])
    data = []
    for i, (name, extra) in enumerate(specs):
        s = {**base, **extra}
        data.append((i, f"rel:{name}", name, s["status"], s["inverse_of"], s["transitive"], s["symmetric"], s["surfaces"]))
    return rows(data, TYPE)


def _triples(df):
    return {(r.source, r.relation, r.target) for r in df.collect()}


def test_registry_later_entry_wins(rows):
    notes = rows([("a", "One", ["x", "two "]), ("b", "Two", [])], "note_id string, title string, aliases array<string>")
    extra = rows([("X", "Extra")], "alias string, title string")
    got = {r.key: r.title for r in G.name_registry(notes, extra).collect()}
    assert got == {"one": "One", "two": "Two", "x": "Extra"}


def test_links_drop_self_and_unknown(rows):
    notes = rows([("a", "One", []), ("b", "Two", [])], "note_id string, title string, aliases array<string>")
    links = rows([("a", "One", 0, "p", " TWO"), ("a", "One", 1, "q", "one"), ("a", "One", 2, "r", "none")],
                 "note_id string, title string, pos int, anchor string, target string")
    got = G.resolve_links(links, G.name_registry(notes)).collect()
    assert [(r.anchor, r.link) for r in got] == [("p", "[[Two|p]]")]


def test_components_against_union_find(rows):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(90)] + [("n000", n) for n in names[100:]]
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    nodes = rows([(n,) for n in names], "node string")
    got = {r.node: r.component for r in G.connected_components(nodes, rows(pairs, "source string, target string")).collect()}
    assert got == {n: find(n) for n in names}


def test_closure_of_a_cycle_is_one_pass(rows):
    edges = rows([(a, "contains", b) for a, b in ("AB", "BC", "CD", "DA")], EDGE)
    got = _triples(ON.closure(edges, _types(rows, ("contains", {"transitive": True}))))
    assert got == {("A", "contains", "C"), ("B", "contains", "D"), ("C", "contains", "A"), ("D", "contains", "B")}


def test_closure_rules_and_provenance(rows):
    edges = rows([("A", "feeds", "B"), ("B", "meets", "C"), ("B", "fed", "A")], EDGE)
    types = _types(rows, ("feeds", {"inverse_of": "rel:fed"}), ("fed", {}), ("meets", {"symmetric": True}), ("off", {"status": "candidate"}))
    got = ON.closure(edges, types).collect()
    assert [(r.source, r.relation, r.target, r.rule, r.via) for r in got] == [
        ("C", "meets", "B", "symmetric", ["B-[meets]->C"])
    ]


def test_transitive_witnesses_by_brute_force(rows):
    rng = random.Random(3)
    pairs = {(rng.randrange(15), rng.randrange(15)) for _ in range(80)}
    pairs = {(f"{a:02d}", f"{b:02d}") for a, b in pairs if a != b}
    edges = rows([(a, "r", b) for a, b in pairs], "source string, relation string, target string")
    got = {(r.source, r.middle, r.target) for r in ON.transitive_witnesses(edges).collect()}
    want = {(a, b, c) for a, b in pairs for b2, c in pairs if b == b2 and a != c and (a, c) in pairs}
    assert got == want and got


def test_property_candidates_need_support_and_skip_known(rows):
    pairs = [(f"a{i}", f"b{i}") for i in range(8)]
    edges = rows([(a, "x", b) for a, b in pairs] + [(b, "y", a) for a, b in pairs], "source string, relation string, target string")
    types = _types(rows, ("x", {}), ("y", {}))
    got = ON.property_candidates(edges, types).collect()
    assert [(r.id, r.support, r.distinct_notes, r.confidence) for r in got] == [("prop:inverse_of:rel:x:rel:y", 8, 16, 0.9)]
    mirrored = rows([("inverse_of", "rel:y", "rel:x")], "property string, type_id string, value string")
    assert ON.property_candidates(edges, types, mirrored).count() == 0
    assert ON.property_candidates(edges, types, min_support=9).count() == 0


def test_induction_thresholds_and_names(rows):
    data = [(f"n{i % 3}", "feeds into", f"t{i}") for i in range(5)] + [("n1", "eats", "x"), ("n1", "eats", "y"), ("n1", "eats", "z")]
    ev = ON.collect_evidence(rows([*data, ("n1", " ", "x"), ("n2", "uses", "x")], "title string, relation string, target string"))
    got = ON.induce_candidates(ev).collect()
    assert len(got) == 1 and got[0].support == 5 and got[0].distinct_notes == 3 and len(got[0].examples) == 3
    named = ON.induce_candidates(ev, names=rows([(got[0].cluster_key, "Feeds Into")], "cluster_key string, name string")).first()
    assert named.type_id == "rel:feeds-into"
    known = rows([("rel:z", got[0].cluster_key)], "type_id string, surface string")
    assert ON.induce_candidates(ev, known).count() == 0


def test_promotion_gate_and_schema_state(rows):
    cand = rows([("rel:a", "a", 9, 4), ("rel:b", "b", 7, 4), ("rel:c", "c", 9, 2), ("rel:d", "d", 9, 4)],
                "type_id string, name string, support int, distinct_notes int")
    active = _types(rows, ("d2", {}))
    active = active.withColumn("name", F.lit("d"))
    got = {r.type_id: r.blocker for r in ON.promotion_gate(cand, active).collect()}
    assert got["rel:a"] == "" and "support" in got["rel:b"] and "notes" in got["rel:c"] and "conflicts" in got["rel:d"]
    assert {r.blocker for r in ON.promotion_gate(cand, active, force=True).collect()} == {""}
    log = rows([(i, f"2026-01-0{1 + i // 2} 00:00:00", "t", e) for i, e in enumerate(
        ["promoted", "candidate_induced", "promoted", "rejected", "deprecated", "promoted"])],
        "event_seq int, at string, type_id string, event string").withColumn("at", F.col("at").cast("timestamp"))
    state = ON.schema_state(log).first()
    assert (state.status, state.raises) == ("active", 3)
    assert ON.schema_version(ON.schema_state(log)).first().version == 4
    early = ON.schema_state(log, F.lit("2026-01-01 12:00:00").cast("timestamp")).first()
    assert (early.status, early.raises) == ("candidate", 0)


def test_properties_apply_to_both_sides(rows):
    types = _types(rows, ("x", {}), ("y", {}))
    props = rows([("inverse_of", "rel:x", "rel:y", "active"), ("transitive", "rel:x", "", "active"), ("symmetric", "rel:y", "", "candidate")],
                 "property string, type_id string, value string, status string")
    got = {r.type_id: (r.inverse_of, r.transitive, r.symmetric) for r in ON.apply_property(types, props).collect()}
    assert got == {"rel:x": ("rel:y", True, False), "rel:y": ("rel:x", False, False)}


def test_overview_tree_below_threshold_is_empty(rows):
    domains = rows([(f"dom-{i:02d}",) for i in range(12)], "domain_id string")
    areas = rows([(0, "A b", "dom-00"), (1, "A-b", "dom-01"), (1, "A-b", "dom-00"), (2, "", "dom-02"), (3, "Z", "dom-99")], "area_seq long, name string, domain_id string")
    got = {r.domain_id: (r.area_id, r.name) for r in G.overview_tree(areas, domains).collect()}
    assert got["dom-00"] == ("area-a-b", "A b") and got["dom-01"] == ("area-a-b-2", "A-b") and got["dom-02"] == ("area-x", "Area")
    assert got["dom-11"] == ("area-other", "Other") and len(got) == 12
    assert G.overview_tree(areas, domains.where("domain_id < 'dom-05'")).count() == 0


def test_neighborhood_caps_in_order(rows):
    edges = rows([("f", x) for x in "dcb"] + [("b", "a"), ("d", "z")], "source string, target string")
    got = G.neighborhood(rows([("f",)], "focus string"), edges, 2, 5).orderBy("position").collect()
    assert [r.node for r in got] == ["f", "b", "c", "d", "a"]


def test_tiles_make_every_pair_of_a_hot_key_once(spark):
    left = spark.range(60).select((F.col("id") % 50).alias("n"), F.when(F.col("id") < 45, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.range(70).select(F.col("id").alias("m"), F.when(F.col("id") < 50, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = skew.product(left, right, "k", 8)
    key = lambda r: (r.k, r.n, r.m)
    assert sorted(map(key, got.collect())) == sorted(map(key, left.join(right, "k").collect()))
    tiles = got.groupBy(F.spark_partition_id()).count()
    assert got.columns == ["k", "n", "m"] and tiles.count() > 1


def test_tiles_keep_the_rows_of_one_link_together_and_hot_keys_first(spark):
    key = lambda hot: F.when(F.col("id") < hot, "hot").otherwise(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("k")
    left, right = spark.range(60).select(F.col("id").alias("m"), key(40)), spark.range(320).select(F.col("id").alias("n"), key(30)).union(
        spark.range(300).select(F.col("id"), F.lit("hot"))
    )
    got = skew.product(left, right, "k", 4, 100).select("k", "m", "n", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.k, r.m, r.n) for r in got) == sorted((r.k, r.m, r.n) for r in left.join(right, "k").collect())
    places = [(r.part, r.m) for r in got if r.k == "hot"]
    starts = sum(x != y for x, y in zip(places, [None, *places], strict=False))
    assert starts <= 40 * 4  # 330 rows of the right side lie in four columns of tiles
    for part in {r.part for r in got}:
        kinds = [r.k == "hot" for r in got if r.part == part]
        assert kinds == sorted(kinds, reverse=True)


def test_links_of_equal_place_keep_the_largest_target(rows):
    links = rows([("n", "T", 0, "a", t) for t in ("x", "z", "y")], "note_id string, title string, pos int, anchor string, target string")
    registry = rows([(t, t.upper()) for t in "xyz"], "key string, title string")
    assert [r.target for r in G.resolve_links(links, registry).collect()] == ["Z"]
    assert [r.target for r in G.resolve_links(links.orderBy("target"), registry).collect()] == ["Z"]


def test_a_context_that_holds_a_title_twice_gives_one_notice(rows):
    items = rows([(1, "New"), (1, "New"), (1, "Old"), (1, "Old"), (2, "New")], "query_id long, title string")
    edges = rows([("New", "supersedes", "Old")], "source string, type string, target string")
    notes = rows([("n1", "Old")], "note_id string, title string")
    states = rows([("n1", "Superseded by 'New'", "2026-01-02")], "note_id string, text string, valid_from string")
    states = states.withColumn("valid_from", F.col("valid_from").cast("timestamp"))
    got = TM.handover_notices(items, edges, notes, states).collect()
    assert [(r.query_id, r.title) for r in got] == [(1, "New")] and "'Old' since 2026-01-02" in got[0].notice


def test_edges_are_not_dealt_out_by_their_few_relations(spark, rows):
    edges = spark.range(1000).select(F.when(F.col("id") % 9 == 0, "holds").otherwise("likes").alias("relation"), "id")
    surfaces = rows([("likes", "likes"), ("holds", "holds")], "surface string, name string")
    typed = G.relation_type(edges, surfaces)
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert typed.count() == 1000


def test_witnesses_are_not_sorted_for_examples_nobody_asks_for(spark, rows):
    names = ["knows", "part of"]
    types = rows([(k, n, f"rel:{n}", "active", False, False, "") for k, n in enumerate(names)], "seq int, name string, type_id string, status string, transitive boolean, symmetric boolean, inverse_of string")
    pairs = [(f"a{k}", f"b{k}") for k in range(9)]
    told = [(s, "knows", t) for s, t in pairs] + [(t, "knows", s) for s, t in pairs]
    edges = rows(told, "source string, relation string, target string")
    found = ON.property_candidates(edges, types)
    assert [(r.property, r.support, r.distinct_notes, r.examples[0]) for r in found.collect()] == [("symmetric", 9, 18, "a0 -[knows]-> b0 and b0 -[knows]-> a0")]
    plan = found.drop("examples")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Window" in found._jdf.queryExecution().optimizedPlan().toString()
