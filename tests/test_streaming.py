import datetime as dt

from pyspark.sql import functions as F

from lorekeep import schema as SC
from lorekeep.operators import index as I
from lorekeep.operators.blocks import postings_of, term_sums
from lorekeep.streaming import segments as SG
from lorekeep.streaming import streams as ST


def _stream(spark, df, folder, one_file=True):
    (df.coalesce(1) if one_file else df).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def _drain(df, name, mode, spark, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_watch_takes_new_and_changed_files_up_to_the_cap(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, text in (("a.md", "one"), ("b.txt", "two"), ("c.md", "three"), ("big.md", "x" * 20_001), ("d.bin", "no")):
        (src / name).write_text(text)
    (src / ".git").mkdir()
    (src / ".git" / "h.md").write_text("hidden")

    def run(cap, handler=None):
        q = ST.watch_stream(ST.watch_source(spark, str(src)), str(tmp_path / "reg"), str(tmp_path / "out"), str(tmp_path / "cp"), cap, handler)
        q.awaitTermination()
        return {(r.name, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run(2) == {("a.md", "ingested"), ("b.txt", "ingested"), ("c.md", "capped"), ("big.md", "large")}
    (src / "e.md").write_text("one more")
    (src / "a2").mkdir()
    (src / "a2" / "a.md").write_text("one")  # same name and content: unchanged
    assert run(10) >= {("e.md", "ingested"), ("c.md", "ingested")}
    registered = {r.name for r in spark.read.parquet(str(tmp_path / "reg")).collect()}
    assert registered == {"a.md", "b.txt", "c.md", "e.md"}


def test_failed_files_stay_out_of_the_registry(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("one")
    (src / "b.md").write_text("two")
    q = ST.watch_stream(ST.watch_source(spark, str(src)), str(tmp_path / "reg"), str(tmp_path / "out"), str(tmp_path / "cp"), 9, lambda kept: kept.where("name = 'b.md'").select("name"))
    q.awaitTermination()
    assert {r.name for r in spark.read.parquet(str(tmp_path / "reg")).collect()} == {"a.md"}


def test_sessions_close_after_a_gap(spark, rows, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, i, "user", "y" * 300, t0 + dt.timedelta(minutes=i)) for i in range(2)] + [(2, 0, "user", "short", t0), (3, 0, "user", "z" * 500, t0 + dt.timedelta(hours=9))]
    df = rows(data, "conv_id long, turn long, role string, text string, ts timestamp")
    got = _drain(ST.session_stream(_stream(spark, df, tmp_path / "in")), "sessions", "append", spark, tmp_path / "cp")
    assert [(r.conv_id, len(r.transcript)) for r in got] == [(1, 613)]


def test_claim_state_follows_the_log(spark, rows, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STATE_STORE)
    try:
        df = rows([("c1", 0, None, "a"), ("c1", 1, dt.datetime(2026, 1, 1), "a"), ("c2", 0, None, "b")], "claim_id string, seq long, valid_to timestamp, text string")
        got = _drain(ST.claim_stream(_stream(spark, df, tmp_path / "in")), "claims", "update", spark, tmp_path / "cp")
        last = {r.claim_id: (r.seq, r.valid_to is not None) for r in sorted(got, key=lambda r: r.seq)}
        assert last == {"c1": (1, True), "c2": (0, False)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_claim_state_is_an_aggregate_of_any_state_store(spark, rows, tmp_path):
    df = rows([("c1", 1, dt.datetime(2026, 1, 1), "a"), ("c1", 0, None, "a"), ("c2", 0, None, "b")], "claim_id string, seq long, valid_to timestamp, text string")
    got = _drain(ST.claim_stream(_stream(spark, df, tmp_path / "in")), "claims_any", "update", spark, tmp_path / "cp")
    assert {(r.claim_id, r.seq, r.text) for r in got} == {("c1", 1, "a"), ("c2", 0, "b")}


def test_job_stream_flags_illegal_moves(spark, rows, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    df = rows([(1, day(1), 0, "queued"), (1, day(2), 1, "completed"), (1, day(3), 2, "running")], "job_id long, ts timestamp, seq long, state string")
    got = _drain(ST.job_stream(_stream(spark, df, tmp_path / "in")), "jobs", "append", spark, tmp_path / "cp")
    assert {r.seq: (r.previous, r.legal) for r in got} == {0: (None, True), 1: ("queued", False), 2: ("queued", True)}


def test_counters_per_day(spark, rows, tmp_path):
    df = rows([(dt.datetime(2026, 1, 1, 5), "captured"), (dt.datetime(2026, 1, 1, 6), "failed"), (dt.datetime(2026, 1, 9), "skipped")], "ts timestamp, decision string")
    got = _drain(ST.ingest_counters(_stream(spark, df, tmp_path / "in")), "counters", "append", spark, tmp_path / "cp")
    assert [(r.day, r.captured, r.skipped, r.failed) for r in got] == [(dt.datetime(2026, 1, 1), 1, 0, 1)]


def test_incremental_index_equals_a_rebuild(spark, rows, tmp_path):
    from tests.test_temporal import note

    first = rows([note("a", "Alpha beta"), note("b", "Gamma")], SC.NOTES)
    second = rows([note("a", "Alpha delta"), note("c", "Epsilon")], SC.NOTES)
    for part in (first, second):
        SG.index_stream(_stream(spark, part, tmp_path / "in"), str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination()
    live_blocks, corpus = SG.read_segments(spark, str(tmp_path / "idx"))
    live = postings_of(live_blocks)
    final = first.where("note_id = 'b'").unionByName(second)
    cols = ["field", "term", "note_id", "tf", "dl", "hay_len"]
    assert sorted(map(tuple, live.select(*cols).collect())) == sorted(map(tuple, I.build_postings(final).select(*cols).collect()))
    assert corpus.first() == I.corpus_row(final).select(*corpus.columns).first()
    appended = I.append_notes(I.build_postings(first), second)
    assert sorted(map(tuple, appended.select(*cols).collect())) == sorted(map(tuple, live.select(*cols).collect()))


def test_segments_are_merged_replaced_and_replayed(spark, rows, tmp_path):
    import random

    from tests.test_temporal import note

    rng = random.Random(4)
    words = "alpha beta gamma delta épsilon zeta".split()
    folder, live = str(tmp_path / "idx"), {}
    for number in range(7):
        made = {f"n{rng.randrange(25)}": " ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.choice([1, 4, 12]))}
        batch = rows([note(n, t, summary=f"{t} {number}") for n, t in made.items()], SC.NOTES)
        if number == 3:  # a batch that failed half-way is told again
            SG.add_batch(rows([note("n1", "lost half-way")], SC.NOTES), folder, number, 2)
        SG.add_batch(batch, folder, number, 2)
        live.update({n: (t, number) for n, t in made.items()})
    final = rows([note(n, t, summary=f"{t} {k}") for n, (t, k) in live.items()], SC.NOTES)
    blocks, corpus = SG.read_segments(spark, folder)
    cols = ["field", "term", "note_id", "tf", "dl", "hay_len"]
    assert sorted(map(tuple, postings_of(blocks).select(*cols).collect())) == sorted(map(tuple, I.build_postings(final).select(*cols).collect()))
    want = I.corpus_row(final).select(*corpus.columns).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(corpus.first(), want, strict=True))
    assert len(SG._manifest(spark, folder)) < 7
    stored, _ = SG.live_blocks(spark, folder)
    assert stored.where(F.size("gone") > 0).count() > 0
    sums = I.build_postings(final).groupBy("field", "term").agg(F.count(F.lit(1)), F.sum("tf"), F.sum("dl"))
    assert sorted(map(tuple, term_sums(stored).collect())) == sorted(map(tuple, sums.collect()))


def test_late_rows_are_counted_across_restarts(spark, rows, tmp_path):
    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    parts = [[(day(1), "captured"), (day(2), "failed")], [(day(5), "skipped"), (day(1), "captured")], [(day(1), "captured"), (day(4), "captured"), (day(5), "other")]]
    for part in parts:
        source = _stream(spark, rows(part, "ts timestamp, decision string"), tmp_path / "in")
        ST.count_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.day.day: (r.captured, r.skipped, r.failed, r.late) for r in ST.counted(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (1, 0, 0, 2), 2: (0, 0, 1, 0), 4: (1, 0, 0, 0), 5: (0, 1, 0, 0)} or got == {1: (2, 0, 0, 1), 2: (0, 0, 1, 0), 4: (1, 0, 0, 0), 5: (0, 1, 0, 0)}


def test_registered_queries_have_known_operators(spark, small):
    import re

    import __spark_entry__ as entry
    from lorekeep import plans

    queries, oracle, covers = plans.load()
    assert set(oracle) <= set(queries) <= set(entry.queries())
    assert all(re.fullmatch(r"[A-Z]{1,2}\d+", c) for codes in covers.values() for c in codes)
    assert entry.entry(spark).select(F.count(F.lit(1))).first()[0] > 0


def test_blocks_are_stored_and_read_a_few_at_a_time(spark, rows, tmp_path):
    """One row group, and one Arrow batch, hold few blocks however many a file has."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    from lorekeep.operators.blocks import build_blocks
    from tests.test_temporal import note

    notes = rows([note(f"n{k:02d}", f"Title {k}") for k in range(30)], SC.NOTES).coalesce(1)
    SG._store(build_blocks(notes, 1), SG._members(notes), str(tmp_path), "b0")
    files = list(ds.dataset(f"{tmp_path}/blocks/b0").get_fragments())
    groups = [g.num_rows for f in files for g in f.row_groups]
    assert sum(groups) == 30 and max(groups) <= SG.GROUP

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    wide = spark.range(0, 60, 1, 1).select(F.expr("repeat('x', 2000000)").alias("text"))
    told = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(told) == 60 and max(told) <= 9


def test_blocks_of_mostly_dead_notes_are_merged(spark, rows):
    from lorekeep.operators.blocks import build_blocks, merge_blocks
    from tests.test_temporal import note

    notes = rows([note(f"n{k:02d}", f"Title {k} word{k % 7}", summary=f"sum {k}") for k in range(40)], SC.NOTES).coalesce(1)
    gone = F.expr("case when array_contains(notes, 'n39') then array(3) else array(0, 2, 3, 4) end")
    some = merge_blocks(build_blocks(notes, 5).withColumn("gone", gone), 12)
    alive = notes.where("note_id in ('n35', 'n36', 'n37', 'n39') or int(substr(note_id, 2)) % 5 = 1")
    cols = ["field", "term", "note_id", "tf", "dl", "hay_len"]
    want = I.build_postings(alive).select(*cols).collect()
    assert sorted(map(tuple, postings_of(some).select(*cols).collect())) == sorted(map(tuple, want))
