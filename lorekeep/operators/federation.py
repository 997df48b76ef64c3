"""Search over many collections: pointer rows, privacy, boosts and scope policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import search as S

POLICIES = ("project-only", "central-only", "project+central", "all")


def federate(notes: DataFrame, collections: DataFrame, domains: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pointer rows of the federated collections, a report row per collection, and warnings.

    ``notes`` carries collection_id; ``domains`` is (collection_id, title, domain). A collection
    that is federated but has no notes table entry counts as missing.
    """
    live = collections.where("federated")
    cols = ["collection_id", "name", "type", "sensitive"]
    rows = notes.join(live.select(*cols), "collection_id")
    if domains is not None:
        named = domains.groupBy("collection_id", "title").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
        rows = rows.join(named, ["collection_id", "title"], "left")
        rows = rows.withColumn("domains", F.coalesce("domains", F.expr("cast(array() as array<string>)")))
    else:
        rows = rows.withColumn("domains", F.expr("cast(array() as array<string>)"))
    rows = rows.withColumn("row_id", F.concat("collection_id", F.lit("::"), "note_id"))
    counts = notes.groupBy("collection_id").agg(F.count(F.lit(1)).alias("notes"))
    report = collections.join(counts, "collection_id", "left").select(
        "collection_id", "name",
        F.when(F.col("federated"), F.coalesce("notes", F.lit(0))).otherwise(0).alias("notes"),
        F.when(~F.col("federated"), "not federated").when(F.col("notes").isNull(), "missing").otherwise("").alias("skipped"),
    )
    warnings = report.where("skipped = 'missing'").select(
        F.concat(F.lit("collection '"), "name", F.lit("' missing or uninitialized")).alias("warning")
    )
    return {"rows": rows, "report": report, "warnings": warnings}


def federation_status(rows: DataFrame) -> DataFrame:
    """collection and rows, and a total with a NULL collection."""
    return rows.rollup(F.col("name").alias("collection")).agg(F.count(F.lit(1)).alias("rows"))


def search_text() -> Column:
    return F.concat_ws(
        " ", "title", F.array_join("aliases", " "), F.array_join("tags", " "), F.array_join("domains", " "),
        "summary", "retrieval_text",
    )


def federated_search(
    queries: DataFrame, rows: DataFrame, limit: int = 8, include_sensitive: bool = False,
    boosted: list[str] | None = None,
) -> DataFrame:
    """query_id, row_id, rank, score: a pool of 3 * limit, then privacy, boost and re-sort.

    The pool is cut before sensitive rows leave, so they do use up places in it.
    """
    docs = rows.select(F.col("row_id").alias("doc_id"), search_text().alias("text"))
    hits = S.bm25_scores(queries, docs).where("score > 0")
    pool = S.topk(hits, ["query_id"], [S.best("score"), F.asc("doc_id")], 3 * limit, "__r")
    known = pool.join(rows.select(F.col("row_id").alias("doc_id"), "collection_id", "sensitive"), "doc_id")
    if not include_sensitive:
        known = known.where("not sensitive")
    boost = F.when(F.col("collection_id").isin(*(boosted or [""])), S.NEIGHBOUR_COLLECTION_BOOST).otherwise(1.0)
    ranked = S.topk(
        known.withColumn("score", F.col("score") * boost), ["query_id"], [S.best("score"), F.asc("__r")], limit
    )
    return ranked.select("query_id", F.col("doc_id").alias("row_id"), "rank", F.round("score", 4).alias("score"))


def verify_pointers(rows: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose note still exists, and a warning per stale one."""
    keys = ["collection_id", "note_id"]
    have = notes.select(*keys).distinct()
    stale = rows.join(have, keys, "left_anti")
    return rows.join(have, keys, "left_semi"), stale.select(
        F.concat(F.lit("stale pointer: "), "title", F.lit(" in "), "name").alias("warning")
    )


def scoped_search(
    queries: DataFrame, notes: DataFrame, collections: DataFrame, current: str, central: str | None,
    policy: str, limit: int = 5, include_sensitive: bool = False,
) -> DataFrame:
    """query_id, position, scope, collection_id, title under a scope policy.

    Local results come before central or federated ones; a federated hit that the local search
    also found keeps its federated row.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")

    def local(collection: str, scope: str, group: int) -> DataFrame:
        own = notes.where(F.col("collection_id") == collection)
        hits = S.search_notes(queries, own, limit)
        return hits.select(
            "query_id", F.lit(group).alias("group"), "rank", F.lit(scope).alias("scope"),
            F.lit(collection).alias("collection_id"), "title",
        )

    if policy == "all":
        fed = federate(notes, collections)["rows"]
        boosted = [c for c in (current, central) if c is not None]
        hits = federated_search(queries, fed, limit, include_sensitive, boosted)
        good, _ = verify_pointers(
            hits.join(fed.select("row_id", "collection_id", "note_id", "title", "name", "type"), "row_id"), notes
        )
        far = good.select(
            "query_id", F.lit(1).alias("group"), "rank", T.collection_marker("type", "name").alias("scope"),
            "collection_id", "title",
        )
        mine = collections.where(F.col("collection_id") == current).select(
            F.col("collection_id"), T.collection_marker("type", "name").alias("__scope")
        )
        near = local(current, "[central]" if current == central else "[project]", 0)
        near = near.join(mine, "collection_id", "left").withColumn("scope", F.coalesce("__scope", "scope")).drop("__scope")
        near = near.join(far.select("query_id", "collection_id", "title"), ["query_id", "collection_id", "title"], "left_anti")
        out = near.select(*far.columns).unionByName(far)
    else:
        parts = []
        if policy in ("project-only", "project+central"):
            parts.append(local(current, "[project]", 0))
        if central is not None and policy in ("central-only", "project+central"):
            if central != current or policy == "central-only":
                parts.append(local(central, "[central]", 1))
        if not parts:
            return local(current, "", 0).where("false").select(
                "query_id", F.lit(0).alias("position"), "scope", "collection_id", "title"
            )
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return S.topk(out, ["query_id"], [F.asc("group"), F.asc("rank")], limit, "position").select(
        "query_id", "position", "scope", "collection_id", "title"
    )


def register_names(names: DataFrame, base: str, order: str) -> DataFrame:
    """Collections that ask for one name get name, name-2, ..."""
    from lorekeep.operators.graph import unique_suffix

    return unique_suffix(names, base, [order], "name")
