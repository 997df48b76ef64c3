"""Append-only review and job ledgers; their state is always derived from events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions import text as T
from lorekeep.operators import skew
from lorekeep.session import written

# ---- Fixed values ----------------------------------------------------------------------------
LEGAL = {
    "queued": ("running", "cancelled"),
    "running": ("paused", "completed", "failed", "cancelled"),
    "paused": ("running", "cancelled"),
    "failed": ("running", "cancelled"),
    "completed": (),
    "cancelled": (),
}
TERMINAL = ("completed", "cancelled")
REVIEW_KINDS = (
    "duplicate_concept", "correction", "ontology_candidate", "property", "stale_source",
    "low_confidence_note", "scan_safety", "supersedes",
)
# ----------------------------------------------------------------------------------------------


_START = "__start"
_PLACES = (None, *LEGAL)


def _after() -> dict[str | None, tuple[int, ...]]:
    """Per event the place in ``_PLACES`` it leads to from every place; an illegal move stays."""
    moves = {None: ("queued",), **LEGAL}
    return {e: tuple(_PLACES.index(e) if e in moves[now] else k for k, now in enumerate(_PLACES)) for e in LEGAL}


def _batches(kinds: list, names: list[str], rows: list[tuple], before: pa.RecordBatch | None = None):
    """``rows`` as columns behind those of ``before``."""
    columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
    if rows:
        yield pa.RecordBatch.from_arrays([*(before.columns if before else []), *columns], names)


def _fold(rows: DataFrame, keys: list[str], value: str, start, step) -> DataFrame:
    """keys and ``value``: the state left by the rows of each key, which lie together in order and begin with it."""
    schema = T_.StructType([*[rows.schema[k] for k in keys], *T_.StructType.fromDDL(value).fields])
    kinds, width = [f.type for f in to_arrow_schema(schema)], len(keys)

    def run(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:width] != at:
                    if at is not None:
                        done.append((*at, pack(state)))
                    at, state = row[:width], start
                state = step(state, row)
            yield from _batches(kinds, schema.names, done)
        yield from _batches(kinds, schema.names, [(*at, pack(state))] if at is not None else [])

    def pack(state):
        return sum(k << (3 * n) for n, k in enumerate(state))

    return rows.mapInArrow(run, schema)


def _replay(rows: DataFrame, width: int, made: str, start, step) -> DataFrame:
    """Every row with the values ``step(state, row)`` gives it; the first ``width`` columns are the key."""
    added = T_.StructType.fromDDL(made)
    schema = T_.StructType([*rows.schema.fields, *added.fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        at, state = None, None
        for batch in batches:
            told = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:width] != at:
                    at, state = row[:width], start(row)
                state, values = step(state, row)
                told.append(values)
            yield from _batches(kinds, schema.names, told, batch)

    return rows.mapInArrow(run, schema)


def transitions(events: DataFrame, rows: int = skew.BUCKET_ROWS) -> DataFrame:
    """Every job event with the state that the last legal move left behind, and whether the event is legal.

    An event is a function on states, and functions compose, so a log of any length is cut into ranges
    of about ``rows`` events: the events of a range are composed to one function, the functions of a job are
    applied one after another to find the state each range begins with, and the ranges are then replayed. As in
    ``job_stream``, an illegal event is reported and changes nothing.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in events.columns if c not in ("job_id", "state")]
    staged = written(events.select("job_id", skew.order_bucket(events, ["ts", "seq"], rows).alias("__b"), "state", *rest))
    after, same = _after(), tuple(range(len(_PLACES)))
    key, order = ["job_id", "__b"], ["job_id", "__b", "ts", "seq"]

    def composed(now, row):
        then = after.get(row[2], same)
        return tuple(then[k] for k in now)

    ranges = staged.select("job_id", "__b", "state", "ts", "seq").repartition(parts, *key).sortWithinPartitions(*order)
    moved = _fold(ranges, key, "moved long", same, composed)

    def begun(now, row):
        return row[2] >> (3 * now) & 7, (now,)

    chained = moved.repartition(parts, "job_id").sortWithinPartitions(*key)
    starts = written(_replay(chained, 1, f"{_START} int", lambda row: 0, begun).drop("moved"))
    joined = staged.alias("e").join(starts.alias("s"), F.col("e.job_id").eqNullSafe(F.col("s.job_id")) & (F.col("e.__b") == F.col("s.__b")))
    joined = joined.select("e.*", f"s.{_START}")
    first = joined.columns.index(_START)

    def told(now, row):
        then = after.get(row[2], same)[now]
        return then, (_PLACES[now], then != now)

    ready = joined.repartition(parts, *key).sortWithinPartitions(*order)
    return _replay(ready, 2, "previous string, legal boolean", lambda row: row[first], told).select(*events.columns, "previous", "legal")


def job_state(events: DataFrame) -> DataFrame:
    return skew.latest(events, ["job_id"], ["ts", "seq"])


def cancel(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """job_id of the jobs a cancel request may end."""
    return states.where(~F.col("state").isin(*TERMINAL)).join(wanted.select("job_id"), "job_id", "left_semi")


def remaining_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items (job_id, item) not done yet: what a resumed job has to do."""
    return items.join(done.select("job_id", "item"), ["job_id", "item"], "left_anti")


def add_reviews(rows: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Review events to append for (kind, title, detail), and the rows of unknown kinds.

    An item's id ends in the whole hash: of its first eight digits, two in 100,000 items would be equal.
    """
    known = F.col("kind").isin(*REVIEW_KINDS)
    item = F.concat("kind", F.lit("-"), F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("-"), T.content_hash(F.concat_ws("|", "kind", "title", "detail")))
    events = rows.where(known).select(
        item.alias("item_id"), "kind", "title", "detail", F.lit("pending").alias("status"),
        now.alias("at"), F.lit("").alias("resolution"),
    )
    return events, rows.where(~known)


def resolve_reviews(states: DataFrame, decisions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Events for (item_id, decision, reason) on pending items, and the decisions that came late.

    Decisions are kept; the first one on an item is final.
    """
    pending = states.where("status = 'pending'").select("item_id", "kind", "title", "detail")
    hit = decisions.join(pending, "item_id")
    default = F.when(
        (F.col("decision") == "applied") & (F.col("kind") == "correction"), "correction written"
    ).when((F.col("decision") == "applied") & (F.col("kind") == "supersedes"), "supersedes recorded").otherwise(F.col("decision"))
    events = hit.select(
        "item_id", "kind", "title", "detail", F.col("decision").alias("status"), now.alias("at"),
        F.coalesce(F.nullif("reason", F.lit("")), default).alias("resolution"),
    )
    return events, decisions.join(pending, "item_id", "left_anti")


def review_state(events: DataFrame) -> DataFrame:
    """Pending until decided; the earliest decision counts."""
    decided = skew.first(events.where("status <> 'pending'"), ["item_id"], ["at"])
    opened = skew.first(events.where("status = 'pending'"), ["item_id"], ["at"])
    return decided.unionByName(opened.join(decided.select("item_id"), "item_id", "left_anti").select(*decided.columns))


def listed(states: DataFrame, key: str, column: str, status: str | None = None) -> DataFrame:
    rows = states if status is None else states.where(F.col(column) == status)
    return rows.orderBy(key)


def corrections_of(events: DataFrame) -> DataFrame:
    """title, summary, body of the applied corrections, for apply_corrections."""
    detail = F.from_json("detail", "title string, summary string, body string")
    return events.where("kind = 'correction' and status = 'applied'").select(detail.alias("d")).select("d.*")


def handovers_of(events: DataFrame) -> DataFrame:
    """old, new, evidence of the applied handovers, for record_supersedes."""
    detail = F.from_json("detail", "old string, new string, reason string")
    return events.where("kind = 'supersedes' and status = 'applied'").select(detail.alias("d")).select(
        "d.old", "d.new", F.coalesce("d.reason", F.lit("")).alias("evidence")
    )


def park_captures(parked: DataFrame, failed: DataFrame, key: str = "digest") -> DataFrame:
    """Failed sessions to add to the parked ones; a session seen before is not added twice.

    ``key`` tells sessions apart. A digest of eight digits does so for a few thousand of them only.
    """
    fresh = skew.first(failed, [key], ["error"])
    return parked.unionByName(fresh.join(parked.select(key), key, "left_anti").select(*parked.columns))


def settle_captures(parked: DataFrame, succeeded: DataFrame, key: str = "digest") -> DataFrame:
    """What stays parked after a retry."""
    return parked.join(succeeded.select(key), key, "left_anti").select(*parked.columns)
