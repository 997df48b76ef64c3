"""Versions and claims on two time axes: as-of reads, supersession, corrections.

Open ends and undated rows are NULL. Writes are expressed as the rows to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import skew
from lorekeep.operators.search import search_notes, topk

MARKER_CONFIDENCE = 0.95
VALIDITY_LINES = 5


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record per key."""
    return skew.latest(log, keys, order)


def current_claims(states: DataFrame) -> DataFrame:
    return states.where("valid_to is null")


def claims_as_of(states: DataFrame, instant: Column) -> DataFrame:
    """Half-open: valid_from <= t < valid_to, a NULL end is unbounded."""
    return states.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= instant))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > instant))
    )


def claims_by_note(states: DataFrame) -> DataFrame:
    """All claims with their position inside the note, newest valid_from first, then claim id."""
    return skew.running(
        states, ["note_id"], skew.order_bucket(states, ["-valid_from", "claim_id"]),
        [F.desc_nulls_last("valid_from"), F.asc("claim_id")], number="position",
    )


def version_numbers(versions: DataFrame) -> DataFrame:
    """Versions numbered oldest first, with the time the next one replaced them."""
    out = skew.running(
        versions, ["note_id"], skew.order_bucket(versions, ["updated_at", "seq"] if "seq" in versions.columns else ["updated_at"]), [F.asc_nulls_first("updated_at"), F.asc("seq")],
        number="version", lead={"__next": "updated_at"},
    )
    return out.withColumn("replaced_at", F.col("__next")).drop("__next")


def note_as_of(versions: DataFrame, instant: Column) -> DataFrame:
    """The version of every note current at one instant; an undated version is always visible."""
    seen = versions.where(F.col("updated_at").isNull() | (F.col("updated_at") <= instant))
    return skew.latest(seen, ["note_id"], ["updated_at", "seq"])


def asof_join(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """For each probe (probe_id, note_id, t) the last version with updated_at <= t, else NULLs.

    Probes and versions are merged on the time axis and the last version is carried forward, in
    two levels (within a range of times, then across ranges), so neither a hot note nor a long history
    needs a range join or lands in one task.
    """
    rest = [c for c in versions.columns if c != "note_id"]
    row = F.struct(*rest)
    empty = F.lit(None).cast(versions.select(row.alias("v")).schema["v"].dataType)
    floor = F.lit("0001-01-01").cast("timestamp")
    v = versions.select(
        "note_id", F.coalesce("updated_at", floor).alias("at"), F.lit(0).alias("side"),
        F.col("seq").alias("tie"), row.alias("v"),
        F.lit(None).cast(dict(probes.dtypes)["probe_id"]).alias("probe_id"),
    )
    p = probes.select(
        "note_id", F.col("t").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(versions.schema["seq"].dataType).alias("tie"),
        empty.alias("v"), "probe_id",
    )
    # ranges of the versions' times; a probe falls into the range of its time
    bucket = skew.order_bucket(v, ["at"])
    line = v.unionByName(p).withColumn("bucket", bucket)
    inner = Window.partitionBy("note_id", "bucket").orderBy("at", "side", "tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    near = line.withColumn("near", F.last("v", ignorenulls=True).over(inner)).where("side = 1")
    ends = line.where("side = 0").groupBy("note_id", "bucket").agg(F.max_by("v", F.struct("at", "tie")).alias("end"))
    marks = ends.unionByName(
        p.select("note_id", bucket.alias("bucket")).distinct().withColumn("end", empty)
    ).groupBy("note_id", "bucket").agg(F.max_by("end", F.col("end").isNotNull()).alias("end"))
    across = Window.partitionBy("note_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("far", F.last("end", ignorenulls=True).over(across)).drop("end")
    found = near.join(carried, ["note_id", "bucket"], "left").withColumn("w", F.coalesce("near", "far"))
    return found.select(
        "probe_id", "note_id", F.col("at").alias("t"), *[F.col("w")[c].alias(c) for c in rest]
    )


def search_as_of(
    queries: DataFrame, notes: DataFrame, versions: DataFrame, instant: Column, limit: int = 5
) -> DataFrame:
    """Today's best hits, each as its version at the instant; notes that did not exist are dropped."""
    hits = search_notes(queries, notes, limit)
    ids = skew.first(notes.select(T.key("title").alias("key"), "note_id"), ["key"], ["note_id"])
    named = hits.join(ids, T.key(hits["title"]) == ids["key"]).select("query_id", "rank", "title", "note_id")
    wanted = versions.join(named.select("note_id").distinct(), "note_id", "left_semi")
    then = note_as_of(wanted, instant)
    return named.join(then, "note_id").select(
        "query_id", "rank", "title", "note_id", "updated_at", F.col("summary").alias("summary_then")
    )


def monotone_timestamps(writes: DataFrame, time: str = "wrote_at", order: str = "seq") -> DataFrame:
    """Add ``updated_at``: the write time, or one microsecond after the previous version."""
    bucket = skew.order_bucket(writes, [order])
    us = F.unix_micros(time)
    ranked = skew.running(writes, ["note_id"], bucket, [F.asc(order)], number="__rn")
    ranked = skew.running(
        ranked, ["note_id"], bucket, [F.asc(order)], maxes={"__lift": us - F.col("__rn")}
    )
    return ranked.withColumn("updated_at", F.timestamp_micros(F.col("__lift") + F.col("__rn"))).drop("__rn", "__lift")


def history_timeline(versions: DataFrame, states: DataFrame) -> DataFrame:
    """note_id, kind, at, until, text: version events and claim events, kept apart by kind."""
    return versions.select(
        "note_id", F.lit("version").alias("kind"), F.col("updated_at").alias("at"),
        F.lit(None).cast("timestamp").alias("until"), F.col("summary").alias("text"),
    ).unionByName(
        states.select("note_id", F.lit("claim").alias("kind"), F.col("valid_from").alias("at"),
                      F.col("valid_to").alias("until"), "text")
    )


# ---- writes ----------------------------------------------------------------------------------


def _claim_id(note_id: Column, text: Column, at: Column) -> Column:
    return F.concat(
        F.lit("claim-"), note_id, F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"),
        T.digest8(F.concat_ws("|", note_id, text, F.unix_micros(at))),
    )


def record_claims(facts: DataFrame, now: Column) -> DataFrame:
    """Log rows that open a claim per (note_id, text, ...); valid_from defaults to now."""
    given = lambda c, other: F.coalesce(F.col(c), other) if c in facts.columns else other
    none = F.lit(None).cast("timestamp")
    return facts.select(
        _claim_id(F.col("note_id").cast("string"), F.col("text"), now).alias("claim_id"),
        F.col("note_id"), F.col("text"),
        given("evidence", F.lit("")).alias("evidence"),
        given("confidence", F.lit(0.8)).alias("confidence"),
        given("valid_from", now).alias("valid_from"), none.alias("valid_to"),
        now.alias("observed_at"), given("source_time", none).alias("source_time"),
        now.alias("transaction_from"), none.alias("transaction_to"),
        F.lit("").alias("invalidated_by"),
    )


def invalidate_claims(states: DataFrame, closings: DataFrame, now: Column) -> DataFrame:
    """Log rows that close the open claims named in (claim_id, invalidated_by[, valid_to])."""
    when = F.coalesce(F.col("__to"), now) if "valid_to" in closings.columns else now
    named = closings.select(
        "claim_id", F.col("invalidated_by").alias("__by"),
        *([F.col("valid_to").alias("__to")] if "valid_to" in closings.columns else []),
    )
    return (
        current_claims(states).join(named, "claim_id")
        .withColumns({"valid_to": when, "invalidated_by": F.col("__by"), "transaction_to": now})
        .select(*states.columns)
    )


def record_supersedes(
    pairs: DataFrame, registry: DataFrame, notes: DataFrame, states: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """What a handover old -> new writes.

    ``pairs`` is (old, new, evidence). Returns the rejected pairs with a reason, the claim log
    rows (closing and marker) and the new ``supersedes`` relations not yet present.
    """
    name = lambda c: registry.select(F.col("key").alias(f"{c}_key"), F.col("title").alias(f"{c}_title"))
    resolved = (
        pairs.withColumns({"old_key": T.key("old"), "new_key": T.key("new")})
        .join(name("old"), "old_key", "left").join(name("new"), "new_key", "left")
        .drop("old_key", "new_key")
    )
    reason = (
        F.when(F.col("old_title").isNull(), F.concat(F.lit("note not found: "), "old"))
        .when(F.col("new_title").isNull(), F.concat(F.lit("note not found: "), "new"))
        .when(F.col("old_title") == F.col("new_title"), F.lit("a note cannot supersede itself"))
    )
    judged = resolved.withColumn("reason", reason)
    good = judged.where("reason is null")
    ids = skew.latest(notes.select("title", "note_id"), ["title"], ["note_id"])
    with_id = good.join(ids.select(F.col("title").alias("old_title"), "note_id"), "old_title")
    says = lambda word: F.concat(F.lit(word), "new_title", F.lit("'"))
    # several successors in one batch: the open claims close once, by the first of them
    closing = (
        current_claims(states).select("claim_id", "note_id").join(with_id, "note_id")
        .groupBy("claim_id").agg(F.min(says("superseded by '")).alias("invalidated_by"))
    )
    closed = invalidate_claims(states, closing, now)
    markers = record_claims(
        with_id.select(
            "note_id", says("Superseded by '").alias("text"), "evidence",
            F.lit(MARKER_CONFIDENCE).alias("confidence"),
        ),
        now,
    )
    have = notes.select(F.col("title").alias("source"), F.explode("relations").alias("r")).where(
        "r.relation = 'supersedes'"
    ).select("source", F.col("r.target").alias("target"))
    relations = (
        good.select(F.col("new_title").alias("source"), F.lit("supersedes").alias("relation"),
                    F.col("old_title").alias("target"), F.lit(MARKER_CONFIDENCE).alias("confidence"))
        .distinct().join(have, ["source", "target"], "left_anti")
    )
    return {
        "rejected": judged.where("reason is not null").select("old", "new", "reason"),
        "closed": closed, "markers": markers, "relations": relations,
    }


def upsert_notes(current: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> dict[str, DataFrame]:
    """Merge a batch into the notes: the new snapshot and the versions to append to the history."""
    from lorekeep.operators.curation import merge_notes

    touched = batch.select("note_id").distinct()
    before = current.join(touched, "note_id", "left_semi")
    merged = merge_notes(before, batch, order)
    return _versioned(current, touched, before, merged, now)


def overwrite_notes(current: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> dict[str, DataFrame]:
    """Replace notes without merging; what they said before goes to the history."""
    touched = batch.select("note_id").distinct()
    before = current.join(touched, "note_id", "left_semi")
    last = skew.latest(batch, ["note_id"], [order]) if order in batch.columns else batch
    return _versioned(current, touched, before, last, now)


def _versioned(current, touched, before, merged, now):
    cols = [c for c in current.columns if c not in ("created_at", "updated_at")]
    old = before.select("note_id", F.col("created_at").alias("__c"), F.col("updated_at").alias("__u"))
    stamped = merged.select(*cols).join(old, "note_id", "left").select(
        *cols,
        F.coalesce("__c", now).alias("created_at"),
        F.greatest(now, F.timestamp_micros(F.unix_micros("__u") + 1)).alias("updated_at"),
    )
    kept = current.join(touched, "note_id", "left_anti")
    return {
        "notes": kept.select(*cols, "created_at", "updated_at").unionByName(stamped),
        "history": before.select(*cols, "created_at", "updated_at"),
    }


def apply_corrections(
    notes: DataFrame, corrections: DataFrame, states: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """A new version per correction (title, summary, body), and the claims that go with it.

    Blank fields keep what the note says. A note without an open claim gets its old fact recorded
    since its creation, so the closed window is honest.
    """
    wanted = corrections.select(T.key("title").alias("k"), F.col("summary").alias("new_summary"), "body")
    hit = notes.join(skew.first(wanted, ["k"], ["new_summary", "body"]), T.key(notes["title"]) == F.col("k")).drop("k")
    body = F.struct(F.lit("definizione").alias("key"), F.col("body").alias("value"))
    others = F.filter("body_sections", lambda s: s["key"] != "definizione")
    has = F.exists("body_sections", lambda s: s["key"] == "definizione")
    in_place = F.transform("body_sections", lambda s: F.when(s["key"] == "definizione", body).otherwise(s))
    corrected = hit.withColumns({
        "body_sections": F.when(F.coalesce("body", F.lit("")) == "", F.col("body_sections"))
        .when(has, in_place).otherwise(F.concat(others, F.array(body))),
        "__old_summary": F.col("summary"),
        "summary": F.coalesce(F.nullif("new_summary", F.lit("")), "summary"),
    })
    out = overwrite_notes(notes, corrected.select(*notes.columns), now)
    evidence = F.coalesce(F.get("sources", F.lit(0))["normalized_path"], F.lit(""))
    open_now = current_claims(states)
    bare = corrected.join(open_now.select("note_id").distinct(), "note_id", "left_anti")
    opened = record_claims(
        bare.select("note_id", F.col("__old_summary").alias("text"), evidence.alias("evidence"),
                    F.col("created_at").alias("valid_from"), "confidence"), now,
    )
    closing = (
        open_now.select("claim_id", "note_id").join(corrected.select("note_id"), "note_id", "left_semi")
        .select("claim_id").unionByName(opened.select("claim_id"))
        .withColumn("invalidated_by", F.lit("correction"))
    )
    closed = invalidate_claims(states.select(*opened.columns).unionByName(opened), closing, now)
    fresh = record_claims(
        corrected.select("note_id", F.col("summary").alias("text"), evidence.alias("evidence"), "confidence"), now
    )
    return {**out, "opened": opened, "closed": closed, "fresh": fresh}


def promote_notes(source: DataFrame, target: DataFrame, titles: DataFrame, origin: str, now: Column) -> dict[str, DataFrame]:
    """Copy notes to another collection by title, tagged with their origin, merged into the target."""
    wanted = titles.select(F.lower("title").alias("k")).distinct()
    tag = F.lit(f"promoted-from:{origin}")
    copies = source.join(wanted, F.lower(source["title"]) == F.col("k"), "left_semi").withColumn(
        "tags", F.array_distinct(F.concat("tags", F.array(tag)))
    )
    return upsert_notes(target, copies.withColumn("seq", F.lit(0)), now)


# ---- reading freshness -----------------------------------------------------------------------


def drop_superseded(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Context items that some note supersedes leave, whether or not the successor is present."""
    old = edges.where("type = 'supersedes'").select(T.note_slug("target").alias("__slug")).distinct()
    return items.join(old, T.note_slug(items["title"]) == old["__slug"], "left_anti")


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def validity_blocks(states: DataFrame, lines: int = VALIDITY_LINES) -> DataFrame:
    """note_id, block: the newest claims of each note as text; only five rows per note travel."""
    closed = F.when(
        F.col("valid_to").isNotNull() & (F.coalesce("invalidated_by", F.lit("")) != ""),
        F.concat(F.lit("; closed: "), "invalidated_by"),
    ).otherwise("")
    line = F.concat(
        F.lit("- "), "text", F.lit(" (valid "), F.coalesce(_day("valid_from"), F.lit("")), F.lit(" → "),
        F.coalesce(_day("valid_to"), F.lit("now")), closed, F.lit(")"),
    )
    best = topk(states, ["note_id"], [F.desc_nulls_last("valid_from"), F.asc("claim_id")], lines)
    return best.groupBy("note_id").agg(
        F.concat(
            F.lit("[fact validity]\n"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda e: e["t"]), "\n"),  # noqa: E501
        ).alias("block")
    )


def handover_notices(items: DataFrame, edges: DataFrame, notes: DataFrame, states: DataFrame) -> DataFrame:
    """query_id, title, notice: a successor in the context names the note it replaced.

    A title that a context holds several times is one note there.
    """
    items = items.select("query_id", "title").distinct()
    hand = edges.where("type = 'supersedes'").select("source", F.col("target").alias("old"))
    dropped = items.select("query_id", F.col("title").alias("old"))
    new = items.select("query_id", F.col("title").alias("source"))
    both = new.join(hand, "source").join(dropped, ["query_id", "old"], "left_semi")
    ids = skew.latest(notes.select(F.col("title").alias("old"), "note_id"), ["old"], ["note_id"])
    marker = (
        states.where(F.col("text").startswith("Superseded by"))
        .groupBy("note_id").agg(F.max("valid_from").alias("since"))
    )
    known = both.join(ids, "old", "left").join(marker, "note_id", "left")
    since = F.coalesce(F.concat(F.lit(" since "), _day("since")), F.lit(""))
    return known.select(
        "query_id", F.col("source").alias("title"),
        F.concat(F.lit("[fact validity] this note supersedes '"), "old", F.lit("'"), since,
                 F.lit(" — the older version is historical, not current.")).alias("notice"),
    )
