"""Merging notes, folding duplicates, provenance health, scans and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import skew

LOW_CONFIDENCE = 0.5
PROSE = ["title", "folder", "summary", "body_sections"]


def _distinct_in_order(rows: DataFrame, column: str, keys) -> DataFrame:
    """note_id, column: the array elements of all rows, first sight of each key kept, in order.

    Repeats are combined before the shuffle; what is gathered per note is its output value.
    """
    flat = rows.select("note_id", "__at", F.posexplode(column).alias("pos", "x"))
    first = flat.groupBy("note_id", keys(F.col("x")).alias("k")).agg(
        F.min(F.struct("__at", "pos")).alias("at"), F.min_by("x", F.struct("__at", "pos")).alias("x")
    )
    return first.groupBy("note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x")), _by_at), lambda e: e["x"]).alias(column)
    )


def _by_at(a: Column, b: Column) -> Column:
    return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)


def merge_notes(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """One note per note_id: arrays united in order, prose of the strictly higher confidence.

    ``existing`` comes first, then the rows of ``new`` by ``order``. The search text gathers every
    text not already contained in it.
    """
    cols = [c for c in existing.columns]
    at = lambda n, o: F.struct(F.lit(n).alias("n"), o.alias("o"))
    rows = existing.withColumn("__at", at(0, F.lit(None).cast(new.schema[order].dataType))).unionByName(
        new.withColumn("__at", at(1, F.col(order))).select(*cols, "__at")
    )
    unions = {
        "aliases": lambda x: x,
        "tags": lambda x: x,
        "relations": lambda x: F.struct(x["source"], x["relation"], x["target"]),
        "proposed_links": lambda x: F.struct(x["anchor"], x["target"]),
        "sources": lambda x: F.struct(x["source_hash"], x["normalized_path"]),
    }
    types = dict(existing.dtypes)
    prose = [c for c in PROSE if c in cols]
    lower = F.coalesce(-F.col("confidence"), F.lit(float("inf")))
    out = rows.groupBy("note_id").agg(
        # the first row among those of the highest confidence
        F.min_by(F.struct(*prose), F.struct(lower, "__at")).alias("base"),
        F.max("confidence").alias("confidence"),
    ).select("note_id", "confidence", *[F.col("base")[c].alias(c) for c in prose])
    # A text already seen with the same confidence changes nothing, so steps are distinct pairs.
    steps = rows.groupBy("note_id", "retrieval_text", "confidence").agg(F.min("__at").alias("at"))
    folded = steps.groupBy("note_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "retrieval_text", "confidence"))).alias("s")
    )
    start = F.struct(F.lit(-1.0).alias("c"), F.lit("").alias("t"))

    def join(base, other):
        return F.when((other != "") & ~F.contains(base, other), T.strip(F.concat(base, F.lit(" "), other))).otherwise(base)

    def step(state, s):
        higher = s["confidence"] > state["c"]
        text = F.when(higher, join(s["retrieval_text"], state["t"])).otherwise(join(state["t"], s["retrieval_text"]))
        return F.struct(F.greatest(state["c"], s["confidence"]).alias("c"), text.alias("t"))

    texts = folded.select("note_id", F.aggregate("s", start, step)["t"].alias("retrieval_text"))
    out = out.join(texts, "note_id")
    for column, keys in unions.items():
        if column in cols:
            united = _distinct_in_order(rows, column, keys)
            out = out.join(united, "note_id", "left").withColumn(
                column, F.coalesce(column, F.expr(f"cast(array() as {types[column]})"))
            )
    stamps = [c for c in ("created_at", "updated_at") if c in cols]
    if stamps:
        times = rows.groupBy("note_id").agg(
            *[F.min_by(c, "__at").alias(c) if c == "created_at" else F.max(c).alias(c) for c in stamps]
        )
        out = out.join(times, "note_id")
    return out.select(*cols)


def rewrite_targets(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """source, relation, target with absorbed titles replaced, each once. canonical: (member, canonical)."""
    return (
        relations.join(canonical.select(F.col("member").alias("target"), "canonical"), "target", "left")
        .select("source", "relation", F.coalesce("canonical", "target").alias("target"))
        .distinct()
    )


def consolidate(notes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold duplicate notes; returns the notes and a one-row count of absorbed ones.

    ``groups`` is (group_seq, canonical, pos, member). A title is absorbed once, by its first
    group, and keeps living as an alias of the canonical note.
    """
    titles = notes.select("title").distinct()
    live = groups.where("member <> canonical").join(titles.withColumnRenamed("title", "member"), "member", "left_semi")
    live = live.join(titles.withColumnRenamed("title", "canonical"), "canonical", "left_semi")
    absorbed = skew.first(live.select("member", "canonical", "group_seq", "pos"), ["member"], ["group_seq", "pos"])
    ids = notes.select(F.col("title").alias("canonical"), F.col("note_id").alias("__cid"))
    order = F.struct("group_seq", "pos")
    members = (
        notes.join(absorbed.join(ids, "canonical"), notes["title"] == F.col("member"))
        .withColumns({
            "aliases": F.concat("aliases", F.array("title")), "note_id": F.col("__cid"), "seq": order,
        })
        .select(*notes.columns, "seq")
    )
    bases = notes.join(absorbed.select(F.col("canonical").alias("title")).distinct(), "title", "left_semi").select(*notes.columns)
    merged = merge_notes(bases, members)
    # the canonical note keeps its own title even when a member has the better prose
    own = bases.select("note_id", F.col("title").alias("__title"))
    merged = (
        merged.join(own, "note_id").withColumn("title", F.col("__title")).drop("__title")
        .withColumn("aliases", F.filter("aliases", lambda a: a != F.col("title")))
    )
    untouched = notes.join(
        absorbed.select(F.col("member").alias("title")).unionByName(absorbed.select(F.col("canonical").alias("title"))),
        "title", "left_anti",
    ).select(*notes.columns)
    # rows of absorbed canonicals would vanish with their own group, so only members leave
    survivors = untouched.unionByName(
        merged.join(absorbed.select(F.col("member").alias("title")), "title", "left_anti").select(*notes.columns)
    )
    if "relations" in notes.columns:
        survivors = _retarget(survivors, absorbed)
    return survivors, absorbed.agg(F.count(F.lit(1)).alias("merged"))


def _retarget(notes: DataFrame, absorbed: DataFrame) -> DataFrame:
    kind = dict(notes.dtypes)["relations"]
    flat = notes.select("note_id", F.posexplode("relations").alias("pos", "r"))
    moved = flat.join(absorbed.select(F.col("member").alias("__t"), "canonical"), F.col("r.target") == F.col("__t"), "left")
    moved = moved.withColumn("x", F.col("r").withField("target", F.coalesce("canonical", "r.target")))
    once = moved.groupBy("note_id", F.struct("x.source", "x.relation", "x.target").alias("k")).agg(
        F.min("pos").alias("at"), F.min_by("x", "pos").alias("x")
    )
    lists = once.groupBy("note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x")), _by_at), lambda e: e["x"]).alias("__r")
    )
    return (
        notes.join(lists, "note_id", "left")
        .withColumn("relations", F.coalesce("__r", F.expr(f"cast(array() as {kind})")))
        .drop("__r").select(*notes.columns)
    )


# ---- provenance ------------------------------------------------------------------------------


def provenance_status(notes: DataFrame, raw_sources: DataFrame, normalized: DataFrame | None = None) -> DataFrame:
    """note_id, title, status: source_missing, source_changed, low_confidence or ok.

    ``raw_sources`` is (path, text_hash) of the re-read texts, ``normalized`` holds the paths of
    derived views, which only prove existence. The first source that resolves decides.
    """
    refs = notes.select("note_id", F.posexplode("sources").alias("pos", "s")).select(
        "note_id", "pos", "s.raw_path", F.substring_index("s.normalized_path", "#", 1).alias("view"),
        F.regexp_replace("s.source_hash", "^sha256:", "").alias("stored"),
    )
    known = refs.join(raw_sources.select(F.col("path").alias("raw_path"), "text_hash"), "raw_path", "left")
    views = raw_sources.select("path") if normalized is None else normalized.select("path").unionByName(raw_sources.select("path"))
    known = known.join(views.distinct().select(F.col("path").alias("view"), F.lit(1).alias("seen")), "view", "left")
    usable = known.where("text_hash is not null or seen = 1")
    decided = skew.first(usable.select("note_id", "pos", "text_hash", "stored"), ["note_id"], ["pos"])
    hexed = (F.length("stored") >= 16) & F.col("stored").rlike("^[0-9a-f]+$")
    n = F.least(F.length("stored"), F.length("text_hash"))
    same = F.substring(F.col("stored"), F.lit(1), n) == F.substring(F.col("text_hash"), F.lit(1), n)
    joined = notes.select("note_id", "title", "confidence").join(
        decided.select("note_id", F.lit(1).alias("found"), (hexed & F.col("text_hash").isNotNull() & ~same).alias("changed")),
        "note_id", "left",
    )
    status = (
        F.when(F.col("found").isNull(), "source_missing")
        .when(F.col("changed"), "source_changed")
        .when(F.col("confidence") < LOW_CONFIDENCE, "low_confidence")
        .otherwise("ok")
    )
    return joined.select("note_id", "title", status.alias("status"))


def verifiability(statuses: DataFrame) -> DataFrame:
    """status, n, and on every row the shares of resolving and of healthy notes in percent."""
    counts = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(
        F.struct(
            F.round(100 * F.sum(F.when(F.col("status") != "source_missing", F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("resolves"),
            F.round(100 * F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("ok"),
        )
    ).scalar()
    return counts.select("status", "n", total["resolves"].alias("source_resolves_pct"), total["ok"].alias("ok_pct"))


def verify_report(statuses: DataFrame, verdicts: DataFrame | None = None, only_stale: bool = False) -> dict[str, DataFrame]:
    """Counters of a batch check and the review rows it files.

    ``verdicts`` is (note_id, ok, summary, body) from a judge; a note without a verdict is ok.
    """
    rows = statuses
    if verdicts is not None and not only_stale:
        rows = rows.join(verdicts, "note_id", "left")
    else:
        rows = rows.withColumns({"ok": F.lit(True), "summary": F.lit(""), "body": F.lit("")})
    healthy = F.col("status") == "ok"
    passed = F.coalesce("ok", F.lit(True))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    checked = healthy & F.lit(not only_stale)
    report = rows.agg(
        count(checked, "checked"), count(checked & passed, "ok"), count(~healthy, "stale"),
        count(checked & ~passed, "corrections_proposed"), count(healthy & F.lit(only_stale), "skipped"),
    )
    stale = rows.where(~healthy).select(
        F.lit("stale_source").alias("kind"), F.concat("title", F.lit(": "), "status").alias("title"),
        F.to_json(F.struct("title", "note_id", "status")).alias("detail"),
    )
    wrong = rows.where(checked & ~passed).select(
        F.lit("correction").alias("kind"), F.concat("title", F.lit(": the note does not match the source")).alias("title"),
        F.to_json(F.struct("title", "summary", "body")).alias("detail"),
    )
    return {"report": report, "reviews": stale.unionByName(wrong)}


def token_efficiency(contents: DataFrame, recall: DataFrame, search: DataFrame) -> DataFrame:
    """One row: tokens of everything, mean tokens of a recall and of a search, savings in percent.

    ``contents`` holds the note texts, the other two one (query_id, content) row per answer. The
    texts count as one string joined by blank lines.
    """
    words = F.regexp_count("content", F.lit(f"{T.NON_BLANK}+"))
    # the joined string has two more characters per text after the first
    whole = contents.agg(
        F.greatest(F.floor((F.sum(F.length("content")) + 2 * (F.count(F.lit(1)) - 1)) / 4), F.sum(words)).alias("load_all"),
        F.count(F.lit(1)).alias("notes"),
    )
    mean = lambda df: df.agg(F.avg(T.estimate_tokens("content")).alias("m")).scalar()
    a, b, total = mean(recall), mean(search), F.col("load_all")
    return whole.select(
        "notes", F.col("load_all").alias("load_all_tokens"),
        F.bround(a, 0).cast("bigint").alias("recall_avg_tokens"), F.bround(b, 0).cast("bigint").alias("search_avg_tokens"),
        F.round((1 - a / total) * 100, 1).alias("recall_savings_pct"),
        F.round((1 - b / total) * 100, 1).alias("search_savings_pct"),
    )


def cost_per_answer(rows: DataFrame, amortized: int = 1000, price_per_1k: float = 0.0) -> DataFrame:
    """Add tokens_per_answer and its price to rows of context, answer and ingest tokens."""
    total = F.col("context_tokens") + F.col("answer_tokens") + F.col("ingest_tokens") / max(amortized, 1)
    return rows.withColumns({
        "tokens_per_answer": F.bround(total, 0).cast("bigint"),
        "eur_per_answer": F.round(total / 1000 * price_per_1k, 6),
    })


def provenance_list(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", F.explode("sources").alias("s")).select(
        "note_id", "s.normalized_path", "s.locator"
    )


def library_listing(notes: DataFrame) -> DataFrame:
    count = lambda c: (F.size(c) if c in notes.columns else F.lit(0)).alias(c[:-1] + "_count")
    return notes.select(
        "note_id", "title", "summary", "confidence", "updated_at",
        count("sources"), count("relations"), count("proposed_links"),
    )


def list_relations(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("relations").alias("r")).select("r.source", "r.relation", "r.target", "r.confidence")


def prune_relations(notes: DataFrame, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """The changed notes only, without their weak relations, and the number removed."""
    kept = F.filter("relations", lambda r: r["confidence"] >= min_confidence)
    pruned = notes.withColumn("__kept", kept).where(F.size("__kept") < F.size("relations"))
    removed = pruned.agg(F.coalesce(F.sum(F.size("relations") - F.size("__kept")), F.lit(0)).alias("removed"))
    return pruned.withColumn("relations", F.col("__kept")).drop("__kept"), removed


def note_lookup(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """asked, note_id: exact slug first, else equal ignoring case; the first note wins."""
    want = asked.select("asked", T.note_slug("asked").alias("slug"), F.lower("asked").alias("low"))
    by_slug = want.join(notes.select(T.note_slug("title").alias("slug"), "note_id"), "slug").select(
        "asked", F.lit(0).alias("how"), "note_id"
    )
    by_case = want.join(notes.select(F.lower("title").alias("low"), "note_id"), "low").select(
        "asked", F.lit(1).alias("how"), "note_id"
    )
    return skew.first(by_slug.unionByName(by_case), ["asked"], ["how", "note_id"]).select("asked", "note_id")


# ---- incremental loads -----------------------------------------------------------------------


def incremental_diff(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``change``: new, changed or skipped, by name and content hash."""
    known = seen.select("name", F.col("hash").alias("__old"))
    old = F.col("__old")
    return new.join(known, "name", "left").withColumn(
        "change", F.when(old.isNull(), "new").when(old == F.col("hash"), "skipped").otherwise("changed")
    ).drop("__old")


def unseen(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Only the rows whose (name, hash) is not registered."""
    return new.join(seen.select("name", "hash"), ["name", "hash"], "left_anti")


def daily_cap(files: DataFrame, cap: int = 50) -> DataFrame:
    """Add ``accepted``: the first ``cap`` files of each day by name.

    Only the cap-th name per day is needed, so the days are cut to ``cap`` rows before a shuffle
    and the rest is compared with that name.
    """
    from lorekeep.operators.search import topk

    first = topk(files.select("day", "name").distinct(), ["day"], [F.asc("name")], cap)
    edge = first.groupBy("day").agg(F.max("name").alias("__last"))
    return files.join(edge, "day").withColumn("accepted", F.col("name") <= F.col("__last")).drop("__last")


def reindex_merge(parsed: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown over cache: non-empty human fields win, machine fields stay; and the removed ids.

    ``parsed`` is (id, title, aliases, tags, summary, body_sections).
    """
    pid = F.coalesce(F.nullif("id", F.lit("")), F.lower(T.note_slug("title")))
    # the slug of a blank title is "untitled", which counts as an id
    p = parsed.select(pid.alias("note_id"), *[F.col(c).alias(f"__{c}") for c in ("title", "aliases", "tags", "summary", "body_sections")])
    text = lambda c: F.coalesce(F.nullif(f"__{c}", F.lit("")), c, F.lit(""))
    many = lambda c: F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")).otherwise(F.coalesce(c, f"__{c}"))
    joined = p.join(cached, "note_id", "left")
    fresh = F.col("confidence").isNull()
    summary_only = F.array(F.struct(F.lit("summary").alias("key"), F.col("__summary").alias("value")))
    changes = {
        "title": text("title"), "aliases": many("aliases"), "tags": many("tags"), "summary": text("summary"),
        "body_sections": F.when(F.size("__body_sections") > 0, F.col("__body_sections")).when(fresh, summary_only).otherwise(F.col("body_sections")),
        "retrieval_text": F.coalesce("retrieval_text", F.col("__title")),
        "folder": F.coalesce("folder", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.8)),
    }
    for c in ("proposed_links", "relations", "sources"):
        if c in cached.columns:
            changes[c] = F.coalesce(c, F.expr(f"cast(array() as {dict(cached.dtypes)[c]})"))
    merged = joined.withColumns({k: v for k, v in changes.items() if k in cached.columns}).select(*cached.columns)
    removed = cached.select("note_id").join(p.select("note_id"), "note_id", "left_anti")
    return merged, removed


def enrich(notes: DataFrame, symptoms: DataFrame) -> DataFrame:
    """The notes whose search text takes up symptom phrases (id, symptoms), each note once."""
    marker = " ~symptoms: "
    said = T.strip("symptoms")
    fit = symptoms.select(F.col("id").alias("note_id"), said.alias("said")).where(
        (F.col("said") != "") & (F.length("said") <= 400) & ~F.col("said").rlike(r"[{}\[\]<>]")
    )
    open_notes = notes.where(~F.contains("retrieval_text", F.lit(marker)))
    last = fit.groupBy("note_id").agg(F.max("said").alias("said"))
    return open_notes.join(last, "note_id").withColumn(
        "retrieval_text", F.concat("retrieval_text", F.lit(marker), "said")
    ).drop("said").select(*notes.columns)


def collection_health(
    collections: DataFrame, notes: DataFrame, reviews: DataFrame, captures: DataFrame,
    candidates: DataFrame, jobs: DataFrame, statuses: DataFrame | None = None,
) -> DataFrame:
    """One row per collection of five counts and an attention flag.

    Each input has collection_id; reviews and candidates carry status, jobs carry state. -1 means
    provenance was not scanned.
    """
    count = lambda df, name: df.groupBy("collection_id").agg(F.count(F.lit(1)).alias(name))
    parts = {
        "notes": notes,
        "reviews_pending": reviews.where("status = 'pending'"),
        "pending_captures": captures,
        "ontology_candidates": candidates.where("status = 'candidate'"),
        "jobs_active": jobs.where("state in ('queued', 'running', 'paused')"),
    }
    if statuses is not None:
        parts["provenance_issues"] = statuses.where("status <> 'ok'")
    out = collections.select("collection_id", "name", "type")
    for name, df in parts.items():
        out = out.join(count(df, name), "collection_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if statuses is None:
        out = out.withColumn("provenance_issues", F.lit(-1))
    flags = [F.col(n) > 0 for n in ("reviews_pending", "pending_captures", "ontology_candidates", "jobs_active", "provenance_issues")]
    attention = flags[0]
    for flag in flags[1:]:
        attention = attention | flag
    return out.withColumn("attention", attention)


def ingest_estimates(texts: DataFrame) -> DataFrame:
    """doc_id, chars, chunks, est_llm_calls, est_input_tokens before a document is read in."""
    from lorekeep.functions.shapes import chunk_counts

    return chunk_counts(texts).withColumns({
        "est_llm_calls": F.col("chunks"), "est_input_tokens": F.floor(F.col("chars") / 4),
    })


def enrich_estimate(notes: DataFrame, batch: int = 20) -> DataFrame:
    open_notes = F.count(F.when(~F.contains("retrieval_text", F.lit(" ~symptoms: ")), 1))
    return notes.agg(open_notes.alias("notes"), F.ceil(open_notes / batch).alias("batches"))
