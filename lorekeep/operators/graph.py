"""Link resolution, the concept graph, components and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import skew
from lorekeep.operators.search import topk
from lorekeep.session import checkpoint, written


def name_registry(notes: DataFrame, extra_aliases: DataFrame | None = None, seq: str = "note_id") -> DataFrame:
    """key, title: trimmed lower-cased names. A later entry overwrites: notes in order, the title
    before its aliases, extra aliases (alias, title) last; of extra aliases the one with the largest
    ``seq`` holds, without that column the largest title."""
    aliases = F.col("aliases") if "aliases" in notes.columns else F.expr("cast(array() as array<string>)")
    names = notes.select(
        "title", F.col(seq).alias("seq"), F.posexplode(F.concat(F.array("title"), aliases)).alias("pos", "name")
    ).select(
        T.key("name").alias("key"), "title",
        F.struct(F.lit(0).alias("layer"), F.col("seq"), F.col("pos")).alias("at"),
    )
    last = names.groupBy("key").agg(F.max_by("title", "at").alias("title"))
    if extra_aliases is None:
        return last
    place = F.struct("seq", "title") if "seq" in extra_aliases.columns else F.col("title")
    extra = extra_aliases.groupBy(T.key("alias").alias("key")).agg(F.max_by("title", place).alias("title"))
    return extra.unionByName(last.join(extra, "key", "left_anti"))


def link_rows(notes: DataFrame) -> DataFrame:
    """note_id, title, pos, anchor, target of every proposed link."""
    return notes.select("note_id", "title", F.posexplode("proposed_links").alias("pos", "l")).select(
        "note_id", "title", "pos", "l.anchor", "l.target"
    )


def resolve_links(links: DataFrame, registry: DataFrame) -> DataFrame:
    """note_id, anchor, target, link: unresolved and self links dropped, last link per anchor kept.

    Of links of one anchor and position the largest target is kept.
    """
    found = (
        links.withColumn("key", T.key("target"))
        .join(registry.select("key", F.col("title").alias("resolved")), "key")
        .where(F.col("resolved") != F.col("title"))
    )
    last = found.groupBy("note_id", "anchor").agg(F.max_by("resolved", F.struct("pos", "resolved")).alias("target"))
    return last.withColumn("link", link_text("target", "anchor"))


def link_text(target: str, anchor: str) -> Column:
    return F.concat(F.lit("[["), target, F.lit("|"), anchor, F.lit("]]"))


def link_resolution_report(links: DataFrame, registry: DataFrame) -> DataFrame:
    """status, n over resolved / unresolved / self."""
    joined = links.withColumn("key", T.key("target")).join(
        registry.select("key", F.col("title").alias("resolved")), "key", "left"
    )
    status = (
        F.when(F.col("resolved").isNull(), "unresolved")
        .when(F.col("resolved") == F.col("title"), "self")
        .otherwise("resolved")
    )
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def relation_rows(notes: DataFrame) -> DataFrame:
    """title, relation, target of the relations and, as blank relation, the proposed links."""
    told = notes.select("title", F.explode("relations").alias("r")).select(
        "title", "r.relation", "r.target"
    )
    proposed = notes.select("title", F.explode("proposed_links").alias("l")).select(
        "title", F.lit("").alias("relation"), "l.target"
    )
    return told.unionByName(proposed)


def relation_type(rows: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """Add ``type``: fixed keyword, then the active surface (surface, name), else ``related``.

    With surfaces, the type is worked out once per distinct relation text and joined back. That table is written, so
    Spark sees how small it is: a few relations over all rows must not deal the rows out by relation.
    """
    if surfaces is None:
        return rows.withColumn("type", F.coalesce(T.fixed_relation("relation"), F.lit("related")))
    names = surfaces.select(F.col("surface").alias("__surface"), F.col("name").alias("__name"))
    texts = rows.select("relation").distinct().withColumns(
        {"__fixed": T.fixed_relation("relation"), "__surface": T.surface_key(T.key("relation"))}
    )
    typed = texts.join(names, "__surface", "left").select(
        "relation", F.coalesce("__fixed", "__name", F.lit("related")).alias("type")
    )
    return rows.join(written(typed), "relation")


def build_ontology_edges(rows: DataFrame, registry: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """source, type, target: typed, resolved, without self edges, each once."""
    return (
        relation_type(rows, surfaces)
        .withColumn("key", T.key("target"))
        .join(registry.select("key", F.col("title").alias("resolved")), "key")
        .where(F.col("resolved") != F.col("title"))
        .select(F.col("title").alias("source"), "type", F.col("resolved").alias("target"))
        .distinct()
    )


def neighbors(concepts: DataFrame, edges: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """concept, title, relation, direction, inferred, rule, via: both directions of every edge.

    A self-loop counts once, as out. Inferred edges keep their rule and their evidence.
    """
    links = edges.select(
        "source", F.col("type").alias("relation"), "target", F.lit(False).alias("inferred"),
        F.lit("").alias("rule"), F.expr("cast(array() as array<string>)").alias("via"),
    )
    if inferred is not None:
        links = links.unionByName(
            inferred.select("source", "relation", "target", F.lit(True).alias("inferred"), "rule", "via")
        )
    keyed = links.select("*", T.key("source").alias("a"), T.key("target").alias("b"))
    tail = ["relation", "inferred", "rule", "via"]
    out = keyed.select(
        F.col("a").alias("key"), F.col("target").alias("title"), F.lit("out").alias("direction"), *tail
    )
    back = keyed.where("a <> b").select(
        F.col("b").alias("key"), F.col("source").alias("title"), F.lit("in").alias("direction"), *tail
    )
    return (
        concepts.select("concept", T.key("concept").alias("key"))
        .join(out.unionByName(back), "key")
        .select("concept", "title", "direction", *tail)
    )


def build_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, raw_path), last write per id; edges, kept as often as written.

    ``relations`` may be absent from the notes.
    """
    me = T.node_id("note", "note_id")
    none = F.lit(None).cast("string")
    number = F.lit(None).cast("double")

    def spread(kind: str, column: str, label, raw=none, source_first=False, edge=None, locator=none, conf=number):
        rows = notes.select("note_id", me.alias("me"), F.posexplode(column).alias("pos", "x"))
        return rows.select(
            "note_id", "pos", T.node_id(kind, label).alias("id"), F.lit(kind).alias("kind"),
            label.alias("label"), raw.alias("raw_path"),
            (T.node_id(kind, label) if source_first else F.col("me")).alias("source"),
            (F.col("me") if source_first else T.node_id(kind, label)).alias("target"),
            edge.alias("type"), locator.alias("locator"), conf.alias("confidence"),
        )

    x = F.col("x")
    parts = [
        spread("alias", "aliases", x, edge=F.lit("has_alias")),
        spread("tag", "tags", x, edge=F.lit("tagged")),
        spread("source", "sources", x["normalized_path"], x["raw_path"], True, F.lit("supports"), x["locator"]),
    ]
    if "relations" in notes.columns:
        parts.append(
            spread("concept", "relations", x["target"], edge=x["relation"], conf=x["confidence"])
        )
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    own = notes.select(
        "note_id", F.lit(-1).alias("pos"), me.alias("id"), F.lit("note").alias("kind"),
        F.col("title").alias("label"), none.alias("raw_path"),
    )
    nodes = skew.latest(
        own.unionByName(all_parts.select(*own.columns)), ["id"], ["note_id", "pos"]
    ).select("id", "kind", "label", "raw_path")
    edges = all_parts.select("source", "target", "type", "locator", "confidence")
    return nodes, edges


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, kind, n: nodes per kind and edges per type."""
    return nodes.groupBy(F.lit("node").alias("part"), "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    )


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"] or 0)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each undirected component, isolates alone.

    Alternating large-star and small-star steps: each is one pre-combined minimum per node and one
    join, so a hub never gathers its neighbours, and the rounds grow with log^2 of the size.
    Every round is checkpointed; the only driver values are a count and a hash per round.
    """
    pairs = (
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = checkpoint(pairs)
    mark = _signature(state)
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = checkpoint(small)
        now = _signature(state)
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node").distinct().join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def cluster_buckets(components: DataFrame, split_at: int = 25, named_from: int = 3) -> DataFrame:
    """component, size, bucket, fallback_name: big, mid or stray."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    bucket = F.when(F.col("size") >= split_at, "big").when(F.col("size") >= named_from, "mid").otherwise("stray")
    return sizes.select(
        "component", "size", bucket.alias("bucket"), F.when(bucket == "mid", F.col("first")).alias("fallback_name")
    )


def degree_top(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The best connected nodes (node, degree) and the edges among them."""
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = (
        nodes.select("node").distinct().join(degree, "node", "left")
        .select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
        .orderBy(F.desc("degree"), F.asc("node"))
        .limit(cap)
    )
    inside = edges.join(top.select(F.col("node").alias("source")), "source", "left_semi").join(
        top.select(F.col("node").alias("target")), "target", "left_semi"
    )
    return top, inside.select(*edges.columns)


def neighborhood(focus: DataFrame, edges: DataFrame, hops: int = 2, cap: int = 60) -> DataFrame:
    """focus, node, hop, position: breadth first, sorted inside a hop, at most cap nodes.

    When a hop fills the cap the answer is complete, so no frontier ever needs more than cap
    rows per focus and the walk stays small around hubs.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(
        edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    )
    seen = focus.select("focus", F.col("focus").alias("node"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = (
            frontier.join(both, frontier.node == both.a)
            .select("focus", F.col("b").alias("node"))
            .distinct()
            .join(seen.select("focus", "node"), ["focus", "node"], "left_anti")
        )
        frontier = topk(reached, ["focus"], [F.asc("node")], cap, "__r").select(
            "focus", "node", F.lit(hop).alias("hop")
        )
        seen = seen.unionByName(frontier)
    return topk(seen, ["focus"], [F.asc("hop"), F.asc("node")], cap, "position")


def unique_suffix(names: DataFrame, base: str, order: list[str], out: str = "id") -> DataFrame:
    """name, name-2, name-3 ... on a clash; the ranks are exact for groups of any size."""
    numbered = skew.running(
        names, [base], skew.order_bucket(names, order), [F.col(c) for c in order],
        number="__n",
    )
    return numbered.withColumn(
        out,
        F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__n"))),
    ).drop("__n")


def domain_partition(assignments: DataFrame, notes: DataFrame) -> DataFrame:
    """domain_seq, domain_id, name, title: the first domain that claims a title keeps it.

    ``assignments`` is (domain_seq, name, title). Unknown titles are ignored, unclaimed ones go
    to "Misc", domains without a member vanish, equal slugs get a number.
    """
    known = assignments.join(notes.select("title").distinct(), "title", "left_semi")
    claimed = skew.first(known.select("title", "domain_seq", "name"), ["title"], ["domain_seq"])
    rest = notes.select("title").distinct().join(claimed.select("title"), "title", "left_anti")
    placed = claimed.withColumn(
        "name", F.when(T.strip("name") == "", F.lit("Domain")).otherwise(T.strip("name"))
    ).unionByName(
        rest.select("title", F.lit(2**31 - 1).cast("bigint").alias("domain_seq"), F.lit("Misc").alias("name"))
    )
    domains = placed.select("domain_seq", "name").distinct().withColumn("slug", T.domain_slug("name"))
    ids = unique_suffix(domains, "slug", ["domain_seq"], "domain_id")
    return placed.join(ids.select("domain_seq", "domain_id"), "domain_seq").select(
        "domain_seq", "domain_id", "name", "title"
    )


def overview_listing(domain_members: DataFrame) -> DataFrame:
    return domain_members.groupBy("domain_id", "name").agg(F.count(F.lit(1)).alias("members"))


def overview_tree(areas: DataFrame, domains: DataFrame, threshold: int = 12) -> DataFrame:
    """area_seq, area_id, name, domain_id; empty below the threshold.

    ``areas`` is (area_seq, name, domain_id). A domain counts once, unknown ids are ignored and
    what is left over goes to "Other".
    """
    total = domains.agg(F.count(F.lit(1)).alias("n")).scalar()
    valid = areas.join(domains.select("domain_id"), "domain_id", "left_semi")
    claimed = skew.first(valid.select("domain_id", "area_seq", "name"), ["domain_id"], ["area_seq"])
    rest = domains.select("domain_id").join(claimed.select("domain_id"), "domain_id", "left_anti")
    last = F.lit(2**31 - 1).cast("bigint")
    other = rest.select("domain_id", last.alias("area_seq"), F.lit("Other").alias("name"))
    # the slug comes from the given name; only the shown name falls back to "Area"
    placed = claimed.unionByName(other)
    named = placed.select("area_seq", "name").distinct().withColumn("slug", T.domain_slug("name", "area-"))
    ids = unique_suffix(named, "slug", ["area_seq"], "area_id").select("area_seq", "area_id")
    shown = F.when(T.strip("name") == "", F.lit("Area")).otherwise(T.strip("name"))
    return (
        placed.join(ids, "area_seq")
        .where(total >= threshold)
        .select("area_seq", "area_id", shown.alias("name"), "domain_id")
    )
