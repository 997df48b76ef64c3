"""Queries over versions, claims, ledgers, curation and the prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import curation as CU
from lorekeep.operators import evaluate as EV
from lorekeep.operators import graph as G
from lorekeep.operators import ledger as LE
from lorekeep.operators import prompts as PR
from lorekeep.operators import skew
from lorekeep.operators import temporal as TM
from lorekeep.plans import adapters as A
from lorekeep.plans import oracle as O
from lorekeep.plans.registry import query
from lorekeep.sources import readers

INSTANT = "1997-06-15 12:00:00"
_AT = f"TIMESTAMP '{INSTANT}'"


def _instant():
    return F.lit(INSTANT).cast("timestamp")


# ---- claims and versions ---------------------------------------------------------------------


@query("W4", sql=f"WITH {O.CLAIMS} SELECT claim_id, note_id, text, valid_from, valid_to FROM claims")
def claim_states(spark, folder):
    return A.claims(spark, folder).select("claim_id", "note_id", "text", "valid_from", "valid_to")


@query("F1", sql=f"WITH {O.CLAIMS} SELECT claim_id, note_id, text, valid_from FROM claims WHERE valid_to IS NULL")
def current_claims(spark, folder):
    return TM.current_claims(A.claims(spark, folder)).select("claim_id", "note_id", "text", "valid_from")


@query("F2", sql=f"WITH {O.CLAIMS} SELECT claim_id, note_id FROM claims WHERE valid_from <= {_AT} AND (valid_to IS NULL OR valid_to > {_AT})")
def claims_as_of(spark, folder):
    return TM.claims_as_of(A.claims(spark, folder), _instant()).select("claim_id", "note_id")


@query("W5", sql=f"""WITH {O.CLAIMS} SELECT claim_id, note_id, row_number() OVER (PARTITION BY note_id ORDER BY valid_from DESC, claim_id) AS position FROM claims""")
def claims_by_note(spark, folder):
    return TM.claims_by_note(A.claims(spark, folder)).select("claim_id", "note_id", "position")


@query("W8", sql=f"""WITH {O.VERSIONS} SELECT note_id, seq, updated_at, row_number() OVER w AS version, lead(updated_at) OVER w AS replaced_at
    FROM versions WINDOW w AS (PARTITION BY note_id ORDER BY updated_at, seq)""")
def version_numbers(spark, folder):
    return TM.version_numbers(A.versions(spark, folder)).select("note_id", "seq", "updated_at", "version", "replaced_at")


@query("J5", sql=f"""WITH {O.VERSIONS} SELECT note_id, updated_at, seq, summary FROM versions WHERE updated_at <= {_AT}
    QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY updated_at DESC, seq DESC) = 1""")
def note_as_of(spark, folder):
    return TM.note_as_of(A.versions(spark, folder), _instant()).select("note_id", "updated_at", "seq", "summary")


@query("J5", sql="""WITH p AS (SELECT o_orderkey AS probe_id, o_custkey AS note_id, o_orderdate - INTERVAL 45 DAY AS t FROM orders),
    j AS (SELECT p.*, v.o_orderdate, v.o_orderkey AS seq, v.o_orderpriority AS summary FROM p LEFT JOIN orders v ON v.o_custkey = p.note_id AND v.o_orderdate <= p.t
          QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY v.o_orderdate DESC, v.o_orderkey DESC) = 1)
    SELECT probe_id, note_id, t, seq, summary FROM j""")
def asof_join(spark, folder):
    """For every order the customer's version 45 days before it."""
    probes = A.versions(spark, folder).select(
        F.col("seq").alias("probe_id"), "note_id", (F.col("updated_at") - F.expr("interval 45 days")).alias("t")
    )
    return TM.asof_join(probes, A.versions(spark, folder)).select("probe_id", "note_id", "t", "seq", "summary")


@query("W7", sql="""WITH w AS (SELECT o_custkey AS note_id, o_orderkey AS seq, epoch_us(date_trunc('month', o_orderdate)) AS us FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq) AS rn FROM w)
    SELECT note_id, seq, make_timestamp((max(us - rn) OVER (PARTITION BY note_id ORDER BY seq) + rn)::BIGINT) AS updated_at FROM r""")
def monotone_times(spark, folder):
    """Write times cut to the month, so that many collide."""
    writes = A.versions(spark, folder).withColumn("wrote_at", F.date_trunc("month", "updated_at")).drop("updated_at")
    return TM.monotone_timestamps(writes).select("note_id", "seq", "updated_at")


@query("A30", sql=f"""WITH {O.VERSIONS}, {O.CLAIMS} SELECT note_id, 'version' AS kind, updated_at AS at, NULL::TIMESTAMP AS until, summary AS text FROM versions
    UNION ALL SELECT note_id, 'claim', valid_from, valid_to, text FROM claims""")
def history_timeline(spark, folder):
    return TM.history_timeline(A.versions(spark, folder), A.claims(spark, folder))


@query("J20", sql=f"""WITH {O.CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY valid_from DESC, claim_id) AS p FROM claims)
    SELECT note_id, '[fact validity]' || chr(10) || string_agg('- ' || text || ' (valid ' || strftime(valid_from, '%Y-%m-%d') || ' → '
        || coalesce(strftime(valid_to, '%Y-%m-%d'), 'now') || CASE WHEN valid_to IS NOT NULL THEN '; closed: next order' ELSE '' END || ')', chr(10) ORDER BY p) AS block
    FROM r WHERE p <= 5 GROUP BY note_id""")
def validity_blocks(spark, folder):
    by = F.when(F.col("valid_to").isNotNull(), "next order").otherwise("")
    return TM.validity_blocks(A.claims(spark, folder).withColumn("invalidated_by", by))


@query("F7", sql=f"""WITH {O.NOTES}, {O.CHAIN} SELECT note_id FROM notes n WHERE NOT EXISTS (
    SELECT 1 FROM chain c WHERE c.type = 'part-of' AND {O.slug('c.target')} = {O.slug('n.title')})""")
def not_superseded(spark, folder):
    """A document of the same language as its predecessor counts as superseded by it."""
    from lorekeep.plans.search_queries import doc_chain

    hand = doc_chain(spark, folder).where("type = 'part-of'").withColumn("type", F.lit("supersedes"))
    return TM.drop_superseded(A.notes(spark, folder).select("note_id", "title"), hand).select("note_id")


@query("J19")
def handover_notices(spark, folder):
    """Every source is one context; a document supersedes the next one of its language."""
    from lorekeep.plans.search_queries import doc_chain

    notes = A.notes(spark, folder)
    hand = doc_chain(spark, folder).where("type = 'part-of'").withColumn("type", F.lit("supersedes"))
    items = notes.select(F.col("source").alias("query_id"), "title")
    states = notes.select("note_id", F.concat(F.lit("Superseded by '"), "title", F.lit("'")).alias("text"), F.col("updated_at").alias("valid_from"))
    return TM.handover_notices(items, hand, notes, states)


def _claim_table(spark, folder):
    none = F.lit(None).cast("timestamp")
    return A.claims(spark, folder).select(
        F.col("claim_id").cast("string").alias("claim_id"), F.col("note_id").cast("string").alias("note_id"), "text",
        F.lit("").alias("evidence"), F.lit(0.8).alias("confidence"), "valid_from", "valid_to", none.alias("observed_at"),
        none.alias("source_time"), none.alias("transaction_from"), none.alias("transaction_to"), F.lit("").alias("invalidated_by"),
    )


@query("T4", sql=f"WITH {O.CLAIMS} SELECT claim_id::VARCHAR AS claim_id, TIMESTAMP '2030-01-01' AS valid_to, 'audit' AS invalidated_by FROM claims WHERE valid_to IS NULL AND text = 'F'")
def closed_claims(spark, folder):
    states = _claim_table(spark, folder)
    wanted = states.where("text = 'F'").select("claim_id", F.lit("audit").alias("invalidated_by"))
    return TM.invalidate_claims(states, wanted, F.lit("2030-01-01").cast("timestamp")).select("claim_id", "valid_to", "invalidated_by")


@query("T3", sql="SELECT o_custkey AS note_id, o_orderstatus AS text, o_orderdate AS valid_from, TIMESTAMP '2030-01-01' AS observed_at FROM orders")
def recorded_claims(spark, folder):
    facts = A.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("note_id"), F.col("o_orderstatus").alias("text"), F.col("o_orderdate").alias("valid_from")
    )
    return TM.record_claims(facts, F.lit("2030-01-01").cast("timestamp")).select("note_id", "text", "valid_from", "observed_at")


@query("T5", sql=f"""WITH {O.NOTES}, {O.CHAIN}, reg AS (SELECT {O.key('title')} AS k, arg_max(title, note_id) AS t FROM notes GROUP BY ALL)
    SELECT DISTINCT a.t AS source, b.t AS target FROM chain JOIN reg a ON a.k = {O.key('source')} JOIN reg b ON b.k = {O.key('target')} WHERE a.t <> b.t""")
def new_handovers(spark, folder):
    """Each document supersedes the next one of its source."""
    from lorekeep.plans.search_queries import doc_chain

    notes = A.notes(spark, folder).withColumn("relations", F.expr("cast(array() as array<struct<source:string,relation:string,target:string,confidence:double>>)"))
    pairs = doc_chain(spark, folder).select(F.col("target").alias("old"), F.col("source").alias("new"), F.lit("").alias("evidence"))
    done = TM.record_supersedes(pairs, G.name_registry(notes), notes, _claim_table(spark, folder), F.lit("2030-01-01").cast("timestamp"))
    return done["relations"].select("source", "target")


def _batch(spark, folder):
    """The notes of the documents, and a batch that says them again with another confidence."""
    notes = A.notes(spark, folder, labelled=True)
    fresh = notes.withColumns({
        "tags": F.array(F.lit("again"), F.col("source")), "confidence": F.lit(0.85), "seq": F.col("doc_id"),
        "summary": F.concat(F.lit("again: "), "summary"), "retrieval_text": F.lit("said again"),
    })
    return notes.drop("doc_id", "source"), fresh.drop("doc_id", "source")


_MERGED = f"""{O.NOTES}, m AS (SELECT note_id, lang || ' again ' || source AS tags, CASE WHEN confidence < 0.85 THEN 'again: ' || summary ELSE summary END AS summary,
    sha256({O.strip("CASE WHEN confidence < 0.85 THEN 'said again ' || retrieval_text ELSE retrieval_text || ' said again' END")}) AS text_hash,
    greatest(confidence, 0.85)::DOUBLE AS confidence FROM notes)"""


@query("A24", "U2", "U3", sql=f"WITH {_MERGED} SELECT * FROM m")
def merged_notes(spark, folder):
    old, new = _batch(spark, folder)
    merged = CU.merge_notes(old, new)
    return merged.select(
        "note_id", F.array_join("tags", " ").alias("tags"), "summary", T.content_hash("retrieval_text").alias("text_hash"), "confidence"
    )


@query("T1", "T2", sql=f"WITH {_MERGED} SELECT note_id, summary, confidence, TIMESTAMP '2024-01-01' + to_minutes(substr(note_id, 2)::BIGINT) AS created_at, TIMESTAMP '2030-01-01' AS updated_at FROM m")
def upserted_notes(spark, folder):
    old, new = _batch(spark, folder)
    done = TM.upsert_notes(old, new, F.lit("2030-01-01").cast("timestamp"))
    return done["notes"].select("note_id", "summary", "confidence", "created_at", "updated_at")


@query("T7", sql=f"WITH {O.NOTES} SELECT note_id, lang || ' promoted-from:' || 'src1' AS tags FROM notes WHERE source = 'src1' UNION ALL SELECT note_id, lang FROM notes WHERE source = 'src2'")
def promoted_notes(spark, folder):
    """The notes of src1 copied into src2."""
    notes = A.notes(spark, folder)
    cols = [c for c in notes.columns if c not in ("source", "doc_id")]
    mine, target = notes.where("source = 'src1'").select(*cols), notes.where("source = 'src2'").select(*cols)
    done = TM.promote_notes(mine, target, mine.select("title"), "src1", F.lit("2030-01-01").cast("timestamp"))
    return done["notes"].select("note_id", F.array_join("tags", " ").alias("tags"))


# ---- ledgers ---------------------------------------------------------------------------------

_LEGAL = "CASE {0} WHEN 'queued' THEN {1} IN ('running', 'cancelled') WHEN 'running' THEN {1} IN ('paused', 'completed', 'failed', 'cancelled') WHEN 'paused' THEN {1} IN ('running', 'cancelled') WHEN 'failed' THEN {1} IN ('running', 'cancelled') WHEN 'completed' THEN false ELSE {0} IS NULL AND {1} = 'queued' END"

MOVES = f"""WITH RECURSIVE {O.JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS i FROM jobs),
    w AS (SELECT job_id, i, seq, state, NULL::VARCHAR AS previous, state = 'queued' AS legal, CASE WHEN state = 'queued' THEN state END AS now FROM n WHERE i = 1
      UNION ALL SELECT n.job_id, n.i, n.seq, n.state, w.now, {_LEGAL.format("w.now", "n.state")}, CASE WHEN {_LEGAL.format("w.now", "n.state")} THEN n.state ELSE w.now END
      FROM w JOIN n ON n.job_id = w.job_id AND n.i = w.i + 1)
    SELECT job_id, seq, state, previous, legal FROM w"""


@query("T9", sql=MOVES)
def job_transitions(spark, folder):
    """Every event against the state the last legal one left, in ranges of 2,000 events."""
    return LE.transitions(A.job_events(spark, folder), 2000).select("job_id", "seq", "state", "previous", "legal")


@query("F11", "T9", sql=f"WITH {O.JOBS}, s AS (SELECT job_id, arg_max(state, struct_pack(ts, seq)) AS state FROM jobs GROUP BY job_id) SELECT * FROM s WHERE state = 'failed'")
def failed_jobs(spark, folder):
    return LE.listed(LE.job_state(A.job_events(spark, folder)), "job_id", "state", "failed").select("job_id", "state")


@query("T9", sql="SELECT user_id AS job_id, event_type AS item FROM events GROUP BY ALL EXCEPT SELECT user_id, event_type FROM events WHERE value > 60")
def remaining_items(spark, folder):
    """Event types as items of a user's job; one value above 60 counts as done."""
    events = A.table(spark, folder, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("item"), "value")
    return LE.remaining_items(events.select("job_id", "item").distinct(), events.where("value > 60"))


@query("T8", sql="""SELECT doc_id AS item, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'applied' ELSE 'pending' END AS status FROM labels""")
def review_states(spark, folder):
    """Labelled documents as review items: toxic ones are rejected, good ones applied."""
    labels = A.table(spark, folder, "labels")
    now = F.lit("2030-01-01").cast("timestamp")
    rows = labels.select(F.lit("low_confidence_note").alias("kind"), F.col("doc_id").cast("string").alias("title"), F.lit("{}").alias("detail"))
    opened, _ = LE.add_reviews(rows, now)
    decision = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "applied")
    said = labels.select(F.col("doc_id").cast("string").alias("title"), decision.alias("decision")).where("decision is not null")
    decisions = said.join(opened.select("title", "item_id"), "title").select("item_id", "decision", F.lit("").alias("reason"))
    events, _ = LE.resolve_reviews(opened, decisions, now)
    return LE.review_state(opened.unionByName(events)).select(F.col("title").cast("bigint").alias("item"), "status")


@query("T11", sql="""SELECT conv_id, left(sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)), 8) AS digest FROM conversations
    GROUP BY conv_id HAVING count(*) > 5""")
def parked_captures(spark, folder):
    """Conversations fail first; those of at most five turns succeed on the retry."""
    turns = A.table(spark, folder, "conversations")
    line = F.concat("role", F.lit(": "), "text")
    failed = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda t: t["l"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n"),
    ).select("conv_id", T.digest8("text").alias("digest"), F.lit("engine").alias("error"), "n")
    parked = LE.park_captures(failed.where("false"), failed, "conv_id")
    return LE.settle_captures(parked, failed.where("n <= 5"), "conv_id").select("conv_id", "digest")


# ---- curation --------------------------------------------------------------------------------


@query("J9", sql="""WITH n AS (SELECT 'd' || doc_id AS name, sha256(text) AS hash, lang, source FROM documents),
    s AS (SELECT name, CASE WHEN lang = 'fr' THEN 'old' ELSE hash END AS hash FROM n WHERE lang <> 'es')
    SELECT name, CASE WHEN s.hash IS NULL THEN 'new' WHEN s.hash = n.hash THEN 'skipped' ELSE 'changed' END AS change FROM n LEFT JOIN s USING (name)""")
def incremental_diff(spark, folder):
    """Spanish documents are unknown, French ones have changed."""
    new = A.table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("name"), T.content_hash("text").alias("hash"), "lang"
    )
    seen = new.where("lang <> 'es'").withColumn("hash", F.when(F.col("lang") == "fr", "old").otherwise(F.col("hash")))
    return CU.incremental_diff(new, seen).select("name", "change")


@query("W9", sql="""WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, printf('f%09d', event_id) AS name FROM events)
    SELECT day, name, row_number() OVER (PARTITION BY day ORDER BY name) <= 50 AS accepted FROM f""")
def daily_cap(spark, folder):
    files = A.table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("f%09d", "event_id").alias("name")
    )
    return CU.daily_cap(files, 50).select("day", "name", "accepted")


@query("ST5", sql="""SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'purchase') AS captured, count(*) FILTER (event_type = 'click') AS skipped,
    count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def ingest_counters(spark, folder):
    from lorekeep.streaming.streams import ingest_counters as counters

    rows = A.table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("case event_type when 'purchase' then 'captured' when 'click' then 'skipped' when 'error' then 'failed' else 'other' end").alias("decision"),
    )
    return counters(rows, watermark=None).select("day", "captured", "skipped", "failed")


@query("J11", sql=f"""WITH {O.RING}, {O.relations()} SELECT DISTINCT source, relation, CASE WHEN target LIKE 'supplier:%' THEN 'supplier:' || (substr(target, 10)::BIGINT // 10) ELSE target END AS target FROM rel""")
def rewritten_targets(spark, folder):
    """Ten suppliers share one canonical title."""
    suppliers = A.concepts(spark, folder).where("kind = 'supplier'").select(
        F.col("title").alias("member"), F.concat(F.lit("supplier:"), F.floor(F.substring("title", 10, 18).cast("bigint") / 10).cast("string")).alias("canonical")
    )
    return CU.rewrite_targets(A.relations(spark, folder), suppliers)


@query("A25", sql=f"""WITH {O.NOTES}, g AS (SELECT note_id, lang, source, min(note_id) OVER (PARTITION BY sha256(text)) AS canon FROM notes)
    SELECT canon AS note_id, coalesce(string_agg(note_id, ' ' ORDER BY note_id) FILTER (note_id <> canon), '') AS aliases, count(DISTINCT source) AS sources FROM g GROUP BY canon""")
def consolidated_notes(spark, folder):
    """Copies of one text, each note under its own id as title, folded into the first."""
    notes = A.notes(spark, folder).withColumn("title", F.col("note_id"))
    cols = [c for c in notes.columns if c not in ("source", "doc_id")]
    hashed = notes.select("title", T.content_hash("retrieval_text").alias("h"))
    first = hashed.groupBy("h").agg(F.min("title").alias("canonical"))
    groups = hashed.join(first, "h").select(
        F.substring("canonical", 2, 18).cast("bigint").alias("group_seq"), "canonical",
        F.substring("title", 2, 18).cast("bigint").alias("pos"), F.col("title").alias("member"),
    )
    kept, _ = CU.consolidate(notes.select(*cols), groups)
    return kept.select("note_id", F.array_join("aliases", " ").alias("aliases"), F.size("sources").cast("bigint").alias("sources"))


_PROV = f"""{O.NOTES}, src AS (SELECT source, sha256(min(text)) AS h FROM documents WHERE source NOT IN ('src3', 'src4') GROUP BY source),
    st AS (SELECT n.note_id, CASE WHEN s.h IS NULL THEN 'source_missing' WHEN s.h <> sha256(n.text) THEN 'source_changed' WHEN confidence < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status
           FROM notes n LEFT JOIN src s USING (source))"""


def _statuses(spark, folder):
    docs = A.table(spark, folder, "documents").where("source not in ('src3', 'src4')")
    raw = docs.groupBy(F.col("source").alias("path")).agg(T.content_hash(F.min("text")).alias("text_hash"))
    return CU.provenance_status(A.notes(spark, folder, labelled=True), raw)


@query("A17", sql=f"WITH {_PROV} SELECT note_id, status FROM st")
def provenance_status(spark, folder):
    """The raw file of a source is its smallest text; two sources are gone."""
    return _statuses(spark, folder).select("note_id", "status")


@query("A18", sql=f"""WITH {_PROV}, c AS (SELECT status, count(*) AS n FROM st GROUP BY status) SELECT status, n,
    (SELECT round(100 * sum(n) FILTER (status <> 'source_missing') / sum(n), 1) FROM c) AS source_resolves_pct,
    (SELECT round(100 * coalesce(sum(n) FILTER (status = 'ok'), 0) / sum(n), 1) FROM c) AS ok_pct FROM c""")
def verifiability(spark, folder):
    return CU.verifiability(_statuses(spark, folder))


@query("A18", sql=f"""WITH {_PROV} SELECT count(*) FILTER (status = 'ok') AS checked, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS stale,
    0 AS corrections_proposed, 0 AS skipped FROM st""")
def verify_report(spark, folder):
    return CU.verify_report(_statuses(spark, folder))["report"]


@query("A19", sql=f"""WITH a AS (SELECT greatest((sum(length(text)) + 2 * (count(*) - 1)) // 4, sum(len({O.words('text')}))) AS total, count(*) AS notes FROM documents),
    r AS (SELECT avg({O.estimate('t')}) AS m FROM (SELECT string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)),
    s AS (SELECT avg({O.estimate('text')}) AS m FROM benchmark)
    SELECT notes, total::BIGINT AS load_all_tokens, round_even(r.m, 0)::BIGINT AS recall_avg_tokens, round_even(s.m, 0)::BIGINT AS search_avg_tokens,
           round((1 - r.m / total) * 100, 1) AS recall_savings_pct, round((1 - s.m / total) * 100, 1) AS search_savings_pct FROM a, r, s""")
def token_efficiency(spark, folder):
    """Conversations stand for recalled contexts, passages for search answers."""
    texts = A.table(spark, folder, "documents").select(F.col("text").alias("content"))
    recall = A.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("content")
    )
    return CU.token_efficiency(texts, recall, A.table(spark, folder, "benchmark").select(F.col("text").alias("content")))


@query("A33", sql=f"WITH {O.NOTES} SELECT note_id, source AS normalized_path, 'document' AS locator FROM notes")
def provenance_list(spark, folder):
    return CU.provenance_list(A.notes(spark, folder))


@query("A22", sql=f"WITH {O.NOTES} SELECT note_id, title, summary, confidence, updated_at, 1 AS source_count FROM notes")
def library_listing(spark, folder):
    listing = CU.library_listing(A.notes(spark, folder, labelled=True))
    return listing.select("note_id", "title", "summary", "confidence", "updated_at", "source_count")


@query("F10", sql=f"""WITH {O.NOTES}, a AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN upper(title) ELSE title END AS asked FROM notes),
    b AS (SELECT asked, 0 AS how, note_id FROM a JOIN notes ON {O.slug('asked')} = {O.slug('title')} UNION ALL SELECT asked, 1, note_id FROM a JOIN notes ON lower(asked) = lower(title))
    SELECT asked, arg_min(note_id, struct_pack(how, note_id)) AS note_id FROM b GROUP BY asked""")
def note_lookup(spark, folder):
    """English titles are asked for in capitals."""
    notes = A.notes(spark, folder)
    asked = F.when(F.col("tags")[0] == "en", T.upper("title")).otherwise(F.col("title"))
    return CU.note_lookup(notes.select(asked.alias("asked")).distinct(), notes)


def _weighted(spark, folder):
    """Suppliers as notes; a relation per part, its confidence the largest discount times ten."""
    rows = A.table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg((F.max("l_discount") * 10).alias("c"))
    rel = F.struct(
        F.concat(F.lit("supplier:"), "l_suppkey").alias("source"), F.lit("supplies").alias("relation"),
        F.concat(F.lit("part:"), "l_partkey").alias("target"), F.col("c").alias("confidence"),
    )
    return rows.groupBy(F.concat(F.lit("supplier:"), "l_suppkey").alias("note_id")).agg(F.collect_list(rel).alias("relations"))


_WEIGHTED = """w AS (SELECT 'supplier:' || l_suppkey AS source, 'supplies' AS relation, 'part:' || l_partkey AS target, max(l_discount) * 10 AS confidence FROM lineitem GROUP BY l_suppkey, l_partkey)"""


@query("F3", sql=f"WITH {_WEIGHTED} SELECT source, relation, target, round(confidence, 6) AS confidence FROM w")
def listed_relations(spark, folder):
    return CU.list_relations(_weighted(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@query("F3", sql=f"WITH {_WEIGHTED} SELECT count(*) AS removed FROM w WHERE confidence < 0.5")
def pruned_relations(spark, folder):
    return CU.prune_relations(_weighted(spark, folder), 0.5)[1]


@query("F6", sql=f"""WITH {O.NOTES} SELECT note_id, sha256(retrieval_text || ' ~symptoms: ' || {O.strip('summary')}) AS text_hash FROM notes
    WHERE {O.strip('summary')} <> '' AND length({O.strip('summary')}) <= 400 AND NOT regexp_matches(summary, '[{{}}\\[\\]<>]')""")
def enriched_notes(spark, folder):
    notes = A.notes(spark, folder)
    said = notes.select(F.col("note_id").alias("id"), F.col("summary").alias("symptoms"))
    return CU.enrich(notes, said).select("note_id", T.content_hash("retrieval_text").alias("text_hash"))


@query("A29", sql="SELECT count(*) AS notes, ceil(count(*) / 20)::BIGINT AS batches FROM documents WHERE NOT contains(text, ' ~symptoms: ')")
def enrich_estimate(spark, folder):
    return CU.enrich_estimate(A.notes(spark, folder))


@query("A20", sql=f"""WITH {O.COLLECTIONS}, n AS (SELECT source, count(*) AS notes FROM documents GROUP BY 1),
    r AS (SELECT source, count(*) AS c FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1),
    o AS (SELECT source, count(*) AS c FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1)
    SELECT collection_id, coalesce(notes, 0) AS notes, coalesce(r.c, 0) AS reviews_pending, 0 AS pending_captures, coalesce(o.c, 0) AS ontology_candidates,
           0 AS jobs_active, (coalesce(r.c, 0) > 0 OR coalesce(o.c, 0) > 0) AS attention
    FROM collections LEFT JOIN n ON n.source = collection_id LEFT JOIN r ON r.source = collection_id LEFT JOIN o ON o.source = collection_id""")
def collection_health(spark, folder):
    """Toxic documents wait for review, weak ones stand for open candidates."""
    docs = A.table(spark, folder, "documents").select(F.col("source").alias("collection_id"), "doc_id")
    labelled = docs.join(A.table(spark, folder, "labels"), "doc_id")
    reviews = labelled.where("toxic = 1").withColumn("status", F.lit("pending"))
    candidates = labelled.where("quality = 0").withColumn("status", F.lit("candidate"))
    none = docs.where("false")
    out = CU.collection_health(A.collections(spark, folder), docs, reviews, none, candidates, none.withColumn("state", F.lit("queued")))
    return out.drop("name", "type", "provenance_issues")


@query("W10", sql=f"""WITH b AS (SELECT p_partkey, {O.dash('p_type', 'a-z0-9')} AS base FROM part)
    SELECT p_partkey, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM b)""")
def unique_ids(spark, folder):
    named = A.table(spark, folder, "part").select("p_partkey", F.substring(T.domain_slug("p_type"), 5, 100).alias("base"))
    return G.unique_suffix(named, "base", ["p_partkey"]).select("p_partkey", "id")


_DOMAINS = f"""{O.NOTES}, t AS (SELECT title, min(doc_id % 1000003) AS any_doc, min(substr(source, 4)::BIGINT) AS seq FROM notes WHERE lang <> 'es' GROUP BY title),
    p AS (SELECT title, seq, 'Source ' || seq AS name FROM t UNION ALL SELECT title, 2147483647, 'Misc' FROM (SELECT DISTINCT title FROM notes) WHERE title NOT IN (SELECT title FROM t))"""


def _domains(spark, folder):
    notes = A.notes(spark, folder)
    seq = F.substring("source", 4, 10).cast("bigint")
    claims = notes.where("tags[0] <> 'es'").select(seq.alias("domain_seq"), F.concat(F.lit("Source "), seq.cast("string")).alias("name"), "title")
    return G.domain_partition(claims, notes)


@query("A27", sql=f"WITH {_DOMAINS} SELECT title, seq AS domain_seq, CASE WHEN name = 'Misc' THEN 'dom-misc' ELSE 'dom-source-' || seq END AS domain_id FROM p")
def domain_members(spark, folder):
    """Sources claim the titles of their documents; Spanish ones stay unclaimed."""
    return _domains(spark, folder).select("title", "domain_seq", "domain_id")


@query("A34", sql=f"WITH {_DOMAINS} SELECT name, count(*) AS members FROM p GROUP BY name")
def overview_listing(spark, folder):
    return G.overview_listing(_domains(spark, folder)).select("name", "members")


@query("G7", sql=f"""WITH {_DOMAINS}, d AS (SELECT DISTINCT CASE WHEN name = 'Misc' THEN 'dom-misc' ELSE 'dom-source-' || seq END AS domain_id, seq FROM p)
    SELECT domain_id, CASE WHEN seq = 2147483647 THEN 'Other' ELSE 'Area ' || seq // 5 END AS name,
           CASE WHEN seq = 2147483647 THEN 'area-other' ELSE 'area-area-' || seq // 5 END AS area_id FROM d WHERE (SELECT count(*) FROM d) >= 12""")
def overview_tree(spark, folder):
    """Five sources form an area."""
    domains = _domains(spark, folder).select("domain_id", "domain_seq").distinct()
    fifth = F.floor(F.col("domain_seq") / 5)
    areas = domains.where("domain_id <> 'dom-misc'").select(
        fifth.alias("area_seq"), F.concat(F.lit("Area "), fifth.cast("string")).alias("name"), "domain_id"
    )
    return G.overview_tree(areas, domains.select("domain_id")).select("domain_id", "name", "area_id")


@query("J10", sql=f"""WITH {O.NOTES} SELECT note_id, CASE WHEN lang = 'en' THEN 'Edited ' || note_id ELSE title END AS title, sha256(summary) AS summary_hash, confidence
    FROM notes WHERE lang IN ('en', 'fr')""")
def reindexed_notes(spark, folder):
    """Pages exist for English notes, with a new title, and for French ones, with blank fields."""
    notes = A.notes(spark, folder, labelled=True)
    lang = F.col("tags")[0]
    none = F.expr("cast(array() as array<string>)")
    parsed = notes.where(lang.isin("en", "fr")).select(
        F.col("note_id").alias("id"), F.when(lang == "en", F.concat(F.lit("Edited "), "note_id")).otherwise("").alias("title"),
        none.alias("aliases"), none.alias("tags"), F.lit("").alias("summary"),
        F.expr("cast(array() as array<struct<key:string,value:string>>)").alias("body_sections"),
    )
    merged, _ = CU.reindex_merge(parsed, notes.drop("doc_id", "source"))
    return merged.select("note_id", "title", T.content_hash("summary").alias("summary_hash"), "confidence")


@query("T6", sql=f"""WITH {O.NOTES} SELECT note_id, CASE WHEN lang = 'de' THEN 'fixed ' || note_id ELSE summary END AS summary, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS sections FROM notes""")
def corrected_notes(spark, folder):
    """German notes get a new summary and a definition; note ids serve as titles."""
    notes = A.notes(spark, folder).withColumn("title", F.col("note_id")).drop("doc_id", "source")
    fixes = notes.where("tags[0] = 'de'").select("title", F.concat(F.lit("fixed "), "note_id").alias("summary"), F.lit("text").alias("body"))
    out = TM.apply_corrections(notes, fixes, _claim_table(spark, folder), F.lit("2030-01-01").cast("timestamp"))
    return out["notes"].select("note_id", "summary", F.size("body_sections").alias("sections"))


# ---- sets ------------------------------------------------------------------------------------


@query("U4", sql="SELECT note_id, k FROM (SELECT o_custkey AS note_id, o_orderpriority AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')")
def shared_keys(spark, folder):
    keys = A.table(spark, folder, "orders").select(F.col("o_custkey").alias("note_id"), F.col("o_orderpriority").alias("k"), "o_orderstatus")
    pick = lambda s: keys.where(F.col("o_orderstatus") == s).select("note_id", "k")
    return pick("F").intersect(pick("O"))


@query("U5", sql="SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def unassigned(spark, folder):
    return A.table(spark, folder, "customer").join(
        A.table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"
    ).select("c_custkey")


# ---- answers and judges ----------------------------------------------------------------------


@query("A15", sql="SELECT round(avg((quality = toxic)::INT), 3) AS agreement, count(*) AS n FROM labels")
def judge_agreement(spark, folder):
    labels = A.table(spark, folder, "labels")
    return EV.judge_agreement(
        labels.select("doc_id", F.col("quality").alias("verdict")), labels.select("doc_id", F.col("toxic").alias("verdict")), ["doc_id"]
    )


@query("A32", "M5", sql="SELECT count(quality) AS judged, round(1 - avg(quality), 3) AS hallucination_rate FROM labels")
def hallucination_rate(spark, folder):
    """A judge that answers GROUNDED on good documents."""
    said = F.when(F.col("quality") == 1, "The answer is grounded.").otherwise("HALLUCINATED, not grounded")
    return EV.hallucination_rate(A.table(spark, folder, "labels").select(PR.faithfulness(said).alias("grounded")))


def _answers(spark, folder):
    docs = A.table(spark, folder, "documents").join(A.table(spark, folder, "labels"), "doc_id", "left")
    word = F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "wrong").otherwise("partial"))
    return docs.select("doc_id", F.col("lang").alias("question_type"), PR.correctness(word).alias("verdict").alias("v"), word.alias("word"), "text", "quality")


@query("A16", sql="""WITH a AS (SELECT lang, CASE WHEN quality = 1 THEN 'correct' WHEN quality = 0 AND toxic = 1 THEN 'wrong' WHEN quality = 0 THEN 'partial' END AS v, text FROM documents LEFT JOIN labels USING (doc_id))
    SELECT lang AS question_type, count(*) AS n, count(v) AS judged, round(avg((v = 'correct')::INT), 4) AS accuracy, round(avg(contains(lower(text), 'the')::INT), 4) AS exact_contains FROM a GROUP BY lang
    UNION ALL SELECT NULL, count(*), count(v), round(avg((v = 'correct')::INT), 4), round(avg(contains(lower(text), 'the')::INT), 4) FROM a""")
def accuracy_by_type(spark, folder):
    rows = _answers(spark, folder).select(
        "question_type", F.when(F.col("word").isNotNull(), F.col("v")).alias("verdict"), F.col("text").alias("answer"), F.lit("The").alias("reference")
    )
    return EV.accuracy_by_type(rows)


@query("A14", sql="""WITH a AS (SELECT lang, CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 AND toxic = 1 THEN 0.0 ELSE 0.5 END AS g, coalesce(quality, 0) AS q, contains(text, 'the') AS h FROM documents LEFT JOIN labels USING (doc_id))
    SELECT lang, round(avg(h::INT), 3) AS context_hit, round(avg(q), 3) AS faithfulness, round(avg(g), 3) AS correctness FROM a GROUP BY lang""")
def answer_quality(spark, folder):
    rows = _answers(spark, folder).select(
        F.col("question_type").alias("lang"), F.col("text").contains("the").alias("context_hit"), (F.coalesce("quality", F.lit(0)) == 1).alias("grounded"),
        F.when(F.col("word").isNull(), "partial").otherwise(F.col("v")).alias("correctness"), F.lit(False).alias("negative"), F.col("text").alias("answer"),
    )
    return EV.answer_quality(rows, ["lang"]).drop("refusal_accuracy")


@query("P24", sql="""WITH o AS (SELECT doc_id % 2 = 0 AS linked, lower(text) AS low, regexp_extract(lower(text), '^\\S+') AS v2, regexp_extract(lower(text), '\\S+$') AS v1 FROM documents)
    SELECT linked, count(*) AS n, round(avg(contains(low, v2)::INT), 3) AS current_hit, round(avg((contains(low, v1) AND NOT contains(low, v2))::INT), 3) AS stale,
    round(avg((contains(low, v2) AND (contains(low, v1) OR contains(low, 'until')))::INT), 3) AS change_noted FROM o GROUP BY linked""")
def freshness(spark, folder):
    """A document is the answer; its first word is the new fact, its last word the old one."""
    docs = A.table(spark, folder, "documents")
    low = F.lower("text")
    rows = docs.select(
        (F.col("doc_id") % 2 == 0).alias("linked"), F.col("text").alias("answer"), F.regexp_extract(low, r"^\S+", 0).alias("v2_marker"),
        F.regexp_extract(low, r"\S+\z", 0).alias("v1_marker"),
    )
    return EV.freshness_report(EV.score_freshness(rows, ("until",)))


# ---- prompt tables ---------------------------------------------------------------------------


@query("M2", sql=f"""WITH {O.NOTES}, l AS (SELECT note_id, '- ' || note_id || ' | ' || title || ' — ' || summary || ' — ' || left({O.strip('text')}, 360) AS line, (row_number() OVER (ORDER BY note_id) - 1) // 20 AS batch FROM notes)
    SELECT batch, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY note_id)) AS hash FROM l GROUP BY batch""")
def enrich_batches(spark, folder):
    packed = PR.batched_prompts(A.notes(spark, folder), "note_id", T.note_brief(), 20)
    return packed.select("batch", "n", T.content_hash("listing").alias("hash"))


@query("M1", "P20", sql=f"SELECT doc_id, {O.strip('split_part(text, chr(10), 1)')} AS title, lang || '/' || source AS tags FROM documents WHERE regexp_matches(split_part(text, chr(10), 1), '\\S')")
def parsed_extractions(spark, folder):
    """An answer per document: prose around an array of one note and one nameless entry."""
    item = F.to_json(F.struct(F.substring_index("text", "\n", 1).alias("title"), F.array("lang", "source").alias("tags")))
    answer = F.concat(F.lit("Here are the notes:\n["), item, F.lit(', {"title": " "}]\nDone.'))
    rows = A.table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("raw_path"), F.col("source").alias("normalized_path"),
        F.lit("section 001").alias("locator"), T.source_hash("text").alias("source_hash"), answer.alias("answer"),
    )
    notes, _ = PR.parse_extractions(rows)
    return notes.select(F.col("chunk_id").alias("doc_id"), "title", F.array_join("tags", "/").alias("tags"))


@query("M3", "P20", sql=f"""WITH {O.NOTES}, t AS (SELECT title, count(*) AS c, min(doc_id) AS d FROM notes GROUP BY title),
    g AS (SELECT source, doc_id, title, lead(title) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM notes)
    SELECT doc_id AS answer_id, title AS canonical, unnest([title, nxt]) AS member FROM g WHERE nxt IS NOT NULL AND nxt <> title""")
def parsed_groups(spark, folder):
    """Answers that pair each document with the next of its source and are cut in the middle."""
    notes = A.notes(spark, folder).select("doc_id", "source", "title")
    linked = skew.running(notes, ["source"], skew.order_bucket(notes, ["doc_id"]), [F.asc("doc_id")], lead={"nxt": "title"})
    group = F.to_json(F.struct(F.col("title").alias("canonical"), F.array("title", "nxt").alias("members")))
    cut = F.concat(F.lit("["), group, F.lit(', {"canonical": "x", "members": ["'))
    answers = linked.where("nxt is not null").select(F.col("doc_id").alias("answer_id"), cut.alias("answer"))
    out = PR.parse_groups(answers, notes)
    return out.select(F.col("group_seq.answer_id").alias("answer_id"), "canonical", "member")


@query("M4", sql="""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'applied' ELSE 'review' END AS outcome FROM orders WHERE o_orderstatus <> 'P'""")
def supersede_verdicts(spark, folder):
    """Orders as verdicts: status P is a no, the two most urgent priorities are sure."""
    sure = F.when(F.col("o_orderpriority").rlike("^[12]"), "0.9").otherwise("0.4")
    answer = F.concat(F.lit('Verdict: {"supersedes": '), F.when(F.col("o_orderstatus") == "P", "false").otherwise("true"), F.lit(', "confidence": '), sure, F.lit("}"))
    rows = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("old_title"), F.col("o_orderkey").cast("string").alias("new_title"), answer.alias("answer")
    )
    out = PR.parse_supersede_verdicts(rows)
    key = F.from_json("detail", "old string")["old"]
    return out["applied"].select(F.col("old").cast("bigint").alias("o_orderkey"), F.lit("applied").alias("outcome")).unionByName(
        out["reviews"].select(key.cast("bigint").alias("o_orderkey"), F.lit("review").alias("outcome"))
    )


@query("M6", "W6", sql=f"""WITH r AS (SELECT conv_id, turn + 1 AS rank, role || '/' || turn AS path, text, {O.estimate('text')} AS cost FROM conversations),
    u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY rank) AS used FROM r)
    SELECT conv_id AS query_id, rank AS n, split_part(path, '/', 2) AS name FROM u WHERE used <= 300 OR (rank = 1 AND cost > 300)""")
def answer_sources(spark, folder):
    """The legend of the answers over each conversation's own turns."""
    turns = A.table(spark, folder, "conversations")
    items = turns.select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat("role", F.lit("/"), "turn").alias("path"),
        F.lit("").alias("updated"), F.col("text").alias("content"),
    )
    asked = turns.select(F.col("conv_id").alias("query_id")).distinct().withColumn("text", F.lit("what was said?"))
    return PR.answer_prompts(items, asked, "{question}\n{context}", 300)[1]


@query("R22", sql="""WITH d AS (SELECT DISTINCT source, substr(source, 4)::BIGINT AS seq FROM documents), q AS (SELECT item_id AS query_id, item_id % 23 AS want FROM benchmark)
    SELECT query_id, seq AS domain_seq, count(*) AS members FROM q JOIN d ON seq = want JOIN documents USING (source) GROUP BY ALL""")
def routed_domains(spark, folder):
    """Answers name a source by id, every second time by name; some name none that exists."""
    docs = A.table(spark, folder, "documents")
    seq = F.substring("source", 4, 10).cast("bigint")
    domains = docs.select("source").distinct().select(
        F.concat(F.lit("dom-"), "source").alias("domain_id"), seq.alias("domain_seq"), F.concat(F.lit("Collection "), seq.cast("string"), F.lit("!")).alias("name")
    )
    members = docs.select(F.concat(F.lit("dom-"), "source").alias("domain_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("title"))
    want = (F.col("query_id") % 23).cast("string")
    answer = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("I choose DOM-src"), want, F.lit("."))).otherwise(
        F.concat(F.lit("The collection "), want, F.lit("! fits"))
    )
    asked = A.questions(spark, folder).select("query_id", answer.alias("answer"))
    routed = PR.route_members(asked, domains, members)
    return routed.groupBy("query_id", "domain_seq").agg(F.count(F.lit(1)).alias("members"))


@query("W12", sql=f"""WITH q AS (SELECT item_id AS query_id, lang FROM benchmark, (SELECT DISTINCT lang FROM documents)),
    m AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM q JOIN documents USING (lang) WHERE lang = 'es'),
    {O.QUESTIONS}, {O.bm25('documents', 'doc_id', 'text')},
    h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b_scores QUALIFY rank <= 24),
    x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS x FROM h WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM m) QUALIFY x <= 2),
    n AS (SELECT query_id, count(*) AS n FROM x GROUP BY ALL),
    k AS (SELECT m.query_id, m.doc_id, row_number() OVER (PARTITION BY m.query_id ORDER BY h.rank NULLS LAST, pos) AS position FROM m LEFT JOIN h USING (query_id, doc_id)),
    kk AS (SELECT k.* FROM k LEFT JOIN n USING (query_id) WHERE position <= greatest(8 - coalesce(n, 0), 1))
    SELECT query_id, position, doc_id::VARCHAR AS title, 'overview' AS route FROM kk
    UNION ALL SELECT query_id, x + (SELECT max(position) FROM kk WHERE kk.query_id = x.query_id), doc_id::VARCHAR, 'index' FROM x""")
def selected_members(spark, folder):
    """Every question is routed to the Spanish documents."""
    from lorekeep.operators import search as S

    questions = A.questions(spark, folder)
    docs = A.table(spark, folder, "documents")
    spanish = docs.where("lang = 'es'").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("title"))
    routes = questions.select("query_id", F.lit(0).alias("domain_seq"), F.lit("es").alias("domain"))
    hits = S.bm25_search(questions, docs.select("doc_id", "text"), 24).select("query_id", F.col("doc_id").cast("string").alias("title"), "rank")
    return PR.select_listed(routes, spanish.withColumn("domain", F.lit("es")), hits, 8)


@query("A31", sql="""WITH n AS (SELECT DISTINCT n_chars AS n_notes, greatest(1, n_chars // 10) AS d, greatest(1, greatest(1, n_chars // 10) // 10) AS a FROM documents),
    m AS (SELECT *, 'Given the MAP of domains (name: description) and a QUESTION, return ONLY the names of the relevant domains, comma-separated. No other words.' || chr(10) || chr(10) || 'MAP:' || chr(10) || array_to_string(list_transform(range(d), lambda i: printf('- Example domain %04d: one-line description of the domain''s content', i)), chr(10))
        || chr(10) || chr(10) || 'QUESTION: example question' AS p FROM n)
    SELECT n_notes, greatest(length(p) // 4, len(regexp_extract_all(p, '\\S+')))::BIGINT AS flat_tokens FROM m""")
def routing_curve(spark, folder):
    """The prompt size for as many notes as each document has characters."""
    sizes = A.table(spark, folder, "documents").select(F.col("n_chars").alias("n_notes")).distinct()
    return PR.routing_token_curve(sizes).select("n_notes", F.col("flat_tokens").cast("bigint").alias("flat_tokens"))


@query("J8", "SC12", sql="""WITH f AS (SELECT lang || '/' || source || '/' || CASE WHEN length(text) > 20000 THEN '.hidden/' ELSE '' END || 'd' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.bin' ELSE '.txt' END AS path,
      octet_length(encode(text)) AS bytes, lang, source FROM documents)
    SELECT path, CASE WHEN source = 'src5' THEN '.gitignore' WHEN lang = 'de' THEN 'unsupported type' ELSE '' END AS reason FROM f WHERE source <> 'src5'
    UNION ALL SELECT DISTINCT lang || '/src5/', '.gitignore' FROM f WHERE source = 'src5'""")
def scan_plan(spark, folder):
    """Documents as files: the language decides the suffix, source 5 is ignored."""
    suffix = F.expr("case lang when 'en' then '.md' when 'fr' then '.py' when 'de' then '.bin' else '.txt' end")
    hidden = F.when(F.length("text") > 20000, ".hidden/").otherwise("")
    files = A.table(spark, folder, "documents").select(
        F.concat("lang", F.lit("/"), "source", F.lit("/"), hidden, F.lit("d"), "doc_id", suffix).alias("path"),
        F.octet_length("text").alias("bytes"), F.substring(F.encode("text", "UTF-8"), 1, 1024).alias("head"),
    )
    return readers.scan_tree(files, ["# comment", "src5/", "!keep"]).select("path", "reason")


@query("SK2")
def rendered_notes(spark, folder):
    """Every document as a Markdown page that links to the next one of its source.

    Documents of one title have the same links, so these are resolved once per title.
    """
    from lorekeep.plans.search_queries import doc_chain
    from lorekeep.sources import writers

    notes = A.notes(spark, folder)
    chain = doc_chain(spark, folder).select(F.col("source").alias("title"), "target")
    linked = chain.select(F.col("title").alias("note_id"), "title", F.lit(0).alias("pos"), F.substring_index("title", " ", 1).alias("anchor"), "target")
    found = G.resolve_links(linked.where("anchor <> ''"), G.name_registry(notes)).select(F.col("note_id").alias("title"), "anchor", "link")
    return writers.render_markdown(notes, notes.select("note_id", "title").join(found, "title").drop("title"))


@query("SC7", sql=f"WITH {O.NOTES} SELECT note_id AS id, {O.strip('title')} AS title, lang AS tags FROM notes WHERE {O.strip('title')} <> ''")
def parsed_pages(spark, folder):
    """Pages rendered and read back; ``## Summary`` and the tags survive."""
    from lorekeep.functions.markdown import parse_note_markdown
    from lorekeep.sources import writers

    notes = A.notes(spark, folder).where(T.strip("title") != "")
    none = notes.select("note_id", F.lit("").alias("anchor"), F.lit("").alias("link")).where("false")
    pages = writers.render_markdown(notes, none).select(F.col("note_id").alias("path"), F.col("markdown").alias("text"))
    return parse_note_markdown(pages).select("id", "title", F.array_join("tags", " ").alias("tags"))
