"""Relation-type and property induction, closure, promotion and schema reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import skew
from lorekeep.operators.search import topk
from lorekeep.session import written

MIN_SUPPORT = 3
PROMOTION_SUPPORT = 8
PROMOTION_NOTES = 3


def collect_evidence(rows: DataFrame) -> DataFrame:
    """One row per relation with a target and a surface.

    ``rows`` has title, relation, target and optionally source, source_ref and context.
    """
    given = lambda c, other: F.col(c) if c in rows.columns else other
    subject = F.coalesce(F.nullif(given("source", F.lit("")), F.lit("")), F.col("title"))
    return rows.where((T.strip("target") != "") & (T.strip("relation") != "")).select(
        F.col("title").alias("source_note"),
        given("source_ref", F.lit("")).alias("source_ref"),
        subject.alias("subject"),
        T.strip("relation").alias("predicate_surface"),
        F.col("target").alias("object"),
        given("context", F.lit("")).alias("context"),
        F.coalesce(T.fixed_relation("relation"), F.lit("related")).alias("suggested_type"),
    )


def cluster_unexplained(evidence: DataFrame) -> DataFrame:
    """The evidence the fixed types leave as ``related``, with its cluster key."""
    keyed = evidence.where("suggested_type = 'related'")
    return keyed.withColumn("cluster_key", T.surface_key("predicate_surface")).where("cluster_key <> ''")


def confidence(support: Column) -> Column:
    return F.least(F.lit(0.95), 0.5 + 0.05 * support)


def induce_candidates(
    evidence: DataFrame, known: DataFrame | None = None, names: DataFrame | None = None,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """cluster_key, type_id, name, support, distinct_notes, confidence, examples.

    ``known`` is (type_id, surface) of the schema; ``names`` is (cluster_key, name), the answers
    of a naming model, and may miss any cluster.
    """
    clusters = cluster_unexplained(evidence)
    grouped = clusters.groupBy("cluster_key").agg(
        F.count(F.lit(1)).alias("support"), F.count_distinct("source_note").alias("distinct_notes")
    )
    eligible = grouped.where((F.col("support") >= min_support) & (F.col("distinct_notes") >= 2))
    if known is not None:
        eligible = eligible.join(known.select(F.col("surface").alias("cluster_key")), "cluster_key", "left_anti")
    fallback = F.regexp_replace("cluster_key", r"\s+", "-")
    if names is not None:
        eligible = eligible.join(names.select("cluster_key", T.strip("name").alias("given")), "cluster_key", "left")
        fallback = F.coalesce(F.nullif("given", F.lit("")), fallback)
    named = eligible.withColumn("name", fallback).withColumn("type_id", T.type_id("name"))
    if known is not None:
        named = named.join(known.select("type_id").distinct(), "type_id", "left_anti")
    # two clusters with one id: the first key keeps it
    named = skew.first(named, ["type_id"], ["cluster_key"])
    text = F.concat("subject", F.lit(" —"), "predicate_surface", F.lit("→ "), "object", F.lit(" ("), "source_ref", F.lit(")"))  # noqa: E501
    shown = topk(
        clusters, ["cluster_key"], [F.asc("source_note"), F.asc("object"), F.asc("predicate_surface")], 3
    ).groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))).alias("x"))
    return named.join(shown, "cluster_key").select(
        "cluster_key", "type_id", "name", "support", "distinct_notes",
        confidence(F.col("support")).alias("confidence"),
        F.transform("x", lambda e: e["t"]).alias("examples"),
    )


def schema_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """source, relation, target of the edges whose type is active."""
    active = types.where("status = 'active'").select(F.col("name").alias("type")).distinct()
    return edges.join(active, "type", "left_semi").select("source", F.col("type").alias("relation"), "target")


def edge_ref(source, relation, target) -> Column:
    return F.concat(source, F.lit("-["), relation, F.lit("]->"), target)


def inverse_witnesses(edges: DataFrame, types: DataFrame) -> DataFrame:
    """left_type, right_type, source, target: an edge and its reverse under another active type.

    Each unordered pair of types counts once, the earlier type of the schema on the left.
    """
    active = types.where("status = 'active'").select("seq", "name", F.col("type_id"))
    typed = edges.join(active.withColumnRenamed("name", "relation"), "relation")
    left = typed.select("source", "target", F.col("seq").alias("ls"), F.col("type_id").alias("left_type"),
                        F.col("relation").alias("left_name"))
    right = typed.select(F.col("target").alias("source"), F.col("source").alias("target"),
                         F.col("seq").alias("rs"), F.col("type_id").alias("right_type"),
                         F.col("relation").alias("right_name"))
    return left.join(right, ["source", "target"]).where("ls < rs").drop("ls", "rs")


def symmetric_witnesses(edges: DataFrame) -> DataFrame:
    """relation, source, target: both directions present; each unordered pair once."""
    back = edges.select("relation", F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.join(back, ["relation", "source", "target"], "left_semi").where("source <= target")


def transitive_witnesses(edges: DataFrame) -> DataFrame:
    """relation, source, middle, target with all three edges present.

    Only nodes that a relation both enters and leaves can stand in the middle; most relations have none, and
    their edges go no further. Pairing all edges in and out of a hub would be quadratic. Each closing edge
    a -> c instead walks the shorter of "out of a" and "into c" and looks the third edge up.
    """
    cols = ["relation", "source", "middle", "target"]
    left = edges.select("relation", F.col("source").alias("middle")).distinct()
    middles = written(left.join(edges.select("relation", F.col("target").alias("middle")).distinct(), ["relation", "middle"]))
    first = edges.select("relation", "source", F.col("target").alias("middle")).join(middles, ["relation", "middle"], "left_semi")
    second = edges.select("relation", F.col("source").alias("middle"), "target").join(middles, ["relation", "middle"], "left_semi")
    first, second = written(first.select("relation", "source", "middle")), written(second.select("relation", "middle", "target"))
    out_deg = written(first.groupBy("relation", "source").agg(F.count(F.lit(1)).alias("od")))
    in_deg = written(second.groupBy("relation", "target").agg(F.count(F.lit(1)).alias("id")))
    closing = edges.where("source <> target").select("relation", "source", "target")
    closing = closing.join(out_deg, ["relation", "source"]).join(in_deg, ["relation", "target"])
    closing = closing.withColumn("by_out", F.col("od") <= F.col("id")).drop("od", "id")
    by_out = closing.where("by_out").join(first, ["relation", "source"]).join(second, ["relation", "middle", "target"], "left_semi")
    by_in = closing.where("not by_out").join(second, ["relation", "target"]).join(first, ["relation", "source", "middle"], "left_semi")
    return by_out.select(*cols).unionByName(by_in.select(*cols))


def witness_rows(edges: DataFrame, types: DataFrame) -> DataFrame:
    """property, type_id, value, l, r, a, b, c: every witness of every property, by its relations l and r and its titles in order."""
    active = types.where("status = 'active'").select(F.col("name").alias("relation"), "type_id")
    tail = ["l", "r", "a", "b", "c"]
    names = lambda l, r, *titles: [x.alias(n) for x, n in zip((F.col(l), F.col(r), *titles), tail, strict=True)]  # noqa: E731, E741
    s, t, m, none = F.col("source"), F.col("target"), F.col("middle"), F.lit("")
    inverse = inverse_witnesses(edges, types).select(
        F.lit("inverse_of").alias("property"), F.col("left_type").alias("type_id"),
        F.col("right_type").alias("value"), *names("left_name", "right_name", s, t, none),
    )
    transitive = transitive_witnesses(edges).join(active, "relation").select(
        F.lit("transitive").alias("property"), "type_id", none.alias("value"), *names("relation", "relation", s, m, t)
    )
    symmetric = symmetric_witnesses(edges).join(active, "relation").select(
        F.lit("symmetric").alias("property"), "type_id", none.alias("value"), *names("relation", "relation", s, t, none)
    )
    return inverse.unionByName(transitive).unionByName(symmetric)


def witness_text() -> Column:
    """A row of ``witness_rows`` as it is shown."""
    arrow = lambda s, r, t: F.concat(s, F.lit(" -["), r, F.lit("]-> "), t)
    left, r, a, b, c = (F.col(x) for x in ("l", "r", "a", "b", "c"))
    third = F.concat(arrow(a, r, b), F.lit(" -["), r, F.lit("]-> "), c, F.lit(" witnessed by "), edge_ref(a, r, c))
    return F.when(F.col("property") == "transitive", third).otherwise(F.concat(arrow(a, left, b), F.lit(" and "), arrow(b, r, a)))


def property_candidates(
    edges: DataFrame, types: DataFrame, known: DataFrame | None = None,
    min_support: int = PROMOTION_SUPPORT, min_notes: int = PROMOTION_NOTES,
) -> DataFrame:
    """id, property, type_id, value, support, distinct_notes, confidence, examples.

    ``known`` is (property, type_id, value) of candidates already open or active.
    """
    keys = ["property", "type_id", "value"]
    rows = written(witness_rows(edges, types))  # read three times below, by columns
    support = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    notes = (
        rows.select(*keys, F.explode(F.array("a", "b")).alias("note")).groupBy(*keys)
        .agg(F.count_distinct("note").alias("distinct_notes"))
    )
    shown = topk(rows, keys, [F.asc("a"), F.asc("b"), F.asc("c")], 3).withColumn("example", witness_text()).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "example"))), lambda e: e["example"]).alias("examples")
    )
    found = (
        support.join(notes, keys)
        .where((F.col("support") >= min_support) & (F.col("distinct_notes") >= min_notes))
        .join(_known_properties(types, known), keys, "left_anti")
        .join(shown, keys, "left")  # every candidate has witnesses; without this column Spark need not sort them
    )
    suffix = F.when(F.col("value") == "", "").otherwise(F.concat(F.lit(":"), "value"))
    return found.select(
        F.concat(F.lit("prop:"), "property", F.lit(":"), "type_id", suffix).alias("id"),
        *keys, "support", "distinct_notes", confidence(F.col("support")).alias("confidence"), "examples",
    )


def _known_properties(types: DataFrame, known: DataFrame | None) -> DataFrame:
    flag = lambda name: types.where(name).select(
        F.lit(name).alias("property"), "type_id", F.lit("").alias("value")
    )
    inverse = types.where("coalesce(inverse_of, '') <> ''").select(
        F.lit("inverse_of").alias("property"), "type_id", F.col("inverse_of").alias("value")
    )
    out = flag("transitive").unionByName(flag("symmetric")).unionByName(inverse)
    if known is None:
        return out
    # an inverse pair is unordered: its mirror counts as known
    mirrored = known.where("property = 'inverse_of'").select(
        "property", F.col("value").alias("type_id"), F.col("type_id").alias("value")
    )
    return out.unionByName(known.select("property", "type_id", "value")).unionByName(mirrored)


def closure(edges: DataFrame, types: DataFrame) -> DataFrame:
    """source, relation, target, rule, via: one pass of inverse, symmetric, transitive.

    ``edges`` are the explicit typed edges. No self-loop, nothing explicit; of several
    derivations the first rule in schema order wins, then the first edges in sorted order.
    """
    active = types.where("status = 'active'")
    explicit = schema_edges(edges, types)
    rule = active.select(
        "seq", F.col("name").alias("relation"), "inverse_of", "symmetric", "transitive"
    )
    typed = explicit.join(rule, "relation")
    s, t, r = F.col("source"), F.col("target"), F.col("relation")
    blank = F.lit("")
    inverse = typed.join(
        active.select(F.col("type_id").alias("inverse_of"), F.col("name").alias("inverse_name")), "inverse_of"
    ).select(
        t.alias("source"), F.col("inverse_name").alias("relation"), s.alias("target"),
        F.lit("inverse_of").alias("rule"), F.array(edge_ref(s, r, t)).alias("via"),
        F.struct("seq", F.lit(0).alias("rule"), s.alias("a"), t.alias("b"), blank.alias("c")).alias("order"),
    )
    symmetric = typed.where("symmetric").select(
        t.alias("source"), r, s.alias("target"), F.lit("symmetric").alias("rule"),
        F.array(edge_ref(s, r, t)).alias("via"),
        F.struct("seq", F.lit(1).alias("rule"), s.alias("a"), t.alias("b"), blank.alias("c")).alias("order"),
    )
    hop = typed.where("transitive")
    nxt = hop.select("relation", t.alias("end"), s.alias("target"))
    m, e = F.col("target"), F.col("end")
    transitive = hop.join(nxt, ["relation", "target"]).select(
        s, r, e.alias("target"), F.lit("transitive").alias("rule"),
        F.array(edge_ref(s, r, m), edge_ref(m, r, e)).alias("via"),
        F.struct("seq", F.lit(2).alias("rule"), s.alias("a"), m.alias("b"), e.alias("c")).alias("order"),
    )
    keys = ["source", "relation", "target"]
    derived = inverse.unionByName(symmetric).unionByName(transitive).where("source <> target")
    new = skew.first(derived, keys, ["order"]).drop("order")
    return new.join(explicit.select(*keys), keys, "left_anti").select(*keys, "rule", "via")


def coverage(edges: DataFrame) -> DataFrame:
    typed = F.count(F.when(F.col("type") != "related", 1))
    n = F.count(F.lit(1))
    return edges.agg(
        n.alias("edges"), typed.alias("non_related"),
        F.coalesce(F.round(typed / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("non_related_share"),
    )


def stability(runs: DataFrame) -> DataFrame:
    """Jaccard of the cluster keys over all runs (run, cluster_key); 1.0 without keys."""
    total = runs.select(F.count_distinct("run").alias("n")).scalar()
    keys = runs.where("cluster_key is not null").groupBy("cluster_key").agg(F.count_distinct("run").alias("in_runs"))
    return keys.agg(
        F.coalesce(F.round(F.avg((F.col("in_runs") == total).cast("double")), 4), F.lit(1.0)).alias("jaccard"),
        F.count(F.lit(1)).alias("cluster_keys"),
    )


def schema_status(types: DataFrame, properties: DataFrame) -> DataFrame:
    """status, n: types per status, properties under a prefix."""
    count = F.count(F.lit(1)).alias("n")
    return types.groupBy("status").agg(count).unionByName(
        properties.groupBy(F.concat(F.lit("property_"), "status").alias("status")).agg(count)
    )


def promotion_gate(candidates: DataFrame, active: DataFrame, force: bool = False) -> DataFrame:
    """Add ``blocker``: empty when the candidate may become active."""
    joined = candidates.join(
        active.where("status = 'active'").select("name", F.col("type_id").alias("__other")).distinct(), "name", "left"
    )
    if force:
        return joined.withColumn("blocker", F.lit("")).drop("__other").dropDuplicates(["type_id"])
    clash = F.col("__other").isNotNull() & (F.col("__other") != F.col("type_id"))
    blocker = (
        F.when(F.col("support") < PROMOTION_SUPPORT, F.concat(F.lit("support "), "support", F.lit(f" < {PROMOTION_SUPPORT}")))
        .when(F.col("distinct_notes") < PROMOTION_NOTES, F.concat(F.lit("distinct notes "), "distinct_notes", F.lit(f" < {PROMOTION_NOTES}")))
        .when(clash, F.concat(F.lit("name '"), "name", F.lit("' conflicts with an active type")))
        .otherwise("")
    )
    judged = joined.withColumn("blocker", blocker).drop("__other")
    return judged.groupBy(*[c for c in judged.columns if c != "blocker"]).agg(F.max("blocker").alias("blocker"))


_STATUSES = ("", "candidate", "active", "deprecated")


def _schema_step(state: Column, e: Column) -> Column:
    is_ = lambda name, *status: (e["event"] == name) & state["status"].isin(*status)
    induced, up = is_("candidate_induced", ""), is_("promoted", "candidate", "deprecated")
    rejected, down = is_("rejected", "candidate"), is_("deprecated", "active")
    status = F.when(induced, "candidate").when(up, "active").when(rejected | down, "deprecated")
    return F.struct(
        F.coalesce(status, state["status"]).alias("status"),
        F.when(induced | up, e["at"]).otherwise(state["valid_from"]).alias("valid_from"),
        F.when(rejected | down, e["at"]).otherwise(state["valid_to"]).alias("valid_to"),
        (state["raises"] + (up | down).cast("int")).alias("raises"),
    )


def schema_state(events: DataFrame, at: Column | None = None) -> DataFrame:
    """type_id, status, valid_from, valid_to, raises after the events up to an instant.

    ``events`` is (event_seq, at, type_id, event). Promotion and deprecation raise the schema
    version; a rejection does not. Illegal events (rejecting what is not a candidate, deprecating
    what is not active) are ignored.

    A day of events is folded into the map "status before -> state after", and the maps of the
    days are chained, so no task folds the whole history of a type.
    """
    rows = events if at is None else events.where(F.col("at") <= at)
    none = F.lit(None).cast("timestamp")
    blank = lambda status: F.struct(
        F.lit(status).alias("status"), none.alias("valid_from"), none.alias("valid_to"), F.lit(0).alias("raises")
    )
    steps = rows.groupBy("type_id", F.to_date("at").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("event_seq", "event", "at"))).alias("steps")
    )
    ends = F.array(*[
        F.struct(F.lit(s).alias("before"), F.aggregate("steps", blank(s), _schema_step).alias("after"))
        for s in _STATUSES
    ])
    days = steps.select("type_id", F.struct("day", ends.alias("ends")).alias("d"))

    def chain(state, d):
        after = F.filter(d["ends"], lambda e: e["before"] == state["status"])[0]["after"]
        return F.struct(
            after["status"].alias("status"),
            F.coalesce(after["valid_from"], state["valid_from"]).alias("valid_from"),
            F.coalesce(after["valid_to"], state["valid_to"]).alias("valid_to"),
            (state["raises"] + after["raises"]).alias("raises"),
        )

    folded = days.groupBy("type_id").agg(F.sort_array(F.collect_list("d")).alias("days"))
    return folded.select("type_id", F.aggregate("days", blank(""), chain).alias("s")).select(
        "type_id", "s.status", "s.valid_from", "s.valid_to", "s.raises"
    )


def schema_version(state: DataFrame) -> DataFrame:
    return state.agg((F.lit(1) + F.coalesce(F.sum("raises"), F.lit(0))).alias("version"))


def apply_property(types: DataFrame, properties: DataFrame) -> DataFrame:
    """The types with the active properties set; an inverse is set on both sides."""
    live = properties.where("status = 'active'")
    pairs = live.where("property = 'inverse_of'").select("type_id", F.col("value").alias("__inv"))
    pairs = pairs.unionByName(pairs.select(F.col("__inv").alias("type_id"), F.col("type_id").alias("__inv")))
    flags = live.groupBy("type_id").agg(
        F.max((F.col("property") == "transitive").cast("int")).alias("__t"),
        F.max((F.col("property") == "symmetric").cast("int")).alias("__s"),
    )
    inverse = pairs.groupBy("type_id").agg(F.max("__inv").alias("__inv"))
    return (
        types.join(flags, "type_id", "left").join(inverse, "type_id", "left")
        .withColumns({
            "transitive": F.col("transitive") | (F.coalesce("__t", F.lit(0)) == 1),
            "symmetric": F.col("symmetric") | (F.coalesce("__s", F.lit(0)) == 1),
            "inverse_of": F.coalesce("__inv", "inverse_of"),
        })
        .drop("__t", "__s", "__inv")
    )


def active_surfaces(types: DataFrame) -> DataFrame:
    """surface, name of the active types; the later type wins a shared surface."""
    rows = types.where("status = 'active'").select("seq", "name", F.explode("surfaces").alias("surface"))
    return rows.groupBy("surface").agg(F.max_by("name", "seq").alias("name"))


def rebuild_with_schema(rows: DataFrame, registry: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges re-typed with the active surfaces, and their closure."""
    from lorekeep.operators.graph import build_ontology_edges

    edges = build_ontology_edges(rows, registry, active_surfaces(types))
    return edges, closure(edges, types)
