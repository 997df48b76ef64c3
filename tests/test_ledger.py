"""Ranges by sampled cuts, and job histories in ranges, against plain definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import evaluate as EV
from lorekeep.operators import ledger as LE
from lorekeep.operators import skew


@pytest.mark.parametrize("hot", [0, 900])
def test_ranges_follow_the_order_and_stay_small(spark, hot):
    rng = random.Random(hot)
    data = [(None if k % 50 == 0 else 7 if k < hot else rng.randrange(40), f"t{rng.randrange(30)}", k) for k in range(1000)]
    df = spark.createDataFrame(data, "v long, s string, k long")
    for names in (["v", "s", "k"], ["-v", "k"], ["s", "-k"]):
        cols = [n.lstrip("-") for n in names]
        got = [(tuple(r[c] for c in cols), r.b) for r in df.select(*cols, skew.order_bucket(df, names, 50).alias("b")).collect()]

        def place(row):
            out = []
            for name, value in zip(names, row[0], strict=True):
                number = -1 if value is None else value if not isinstance(value, str) else int(value[1:])
                if isinstance(value, str):
                    number = sorted({f"t{k}" for k in range(30)}).index(value)
                out.append(-number if name.startswith("-") else number)
            return out

        ordered = [b for _, b in sorted(got, key=place)]
        assert ordered == sorted(ordered)
        sizes = [ordered.count(b) for b in set(ordered)]
        assert max(sizes) <= 200 and len(sizes) >= 8
    same = spark.range(100).select(F.lit(1).alias("v"))
    assert same.select(skew.order_bucket(same, ["v"], 10).alias("b")).distinct().count() == 1
    assert df.limit(0).select(skew.order_bucket(df.limit(0), ["v"], 10)).count() == 0


def test_ranges_of_an_order_by_a_place_in_a_file(spark):
    place = F.struct(F.concat(F.lit("part-"), F.col("id") % 3).alias("file"), F.col("id").alias("line"))
    df = spark.range(300).select(place.alias("seq"))
    got = [(tuple(r.seq), r.b) for r in df.select("seq", skew.order_bucket(df, ["seq"], 20).alias("b")).collect()]
    ordered = [b for _, b in sorted(got)]
    assert ordered == sorted(ordered) and len(set(ordered)) >= 8


def test_percentiles_do_not_depend_on_the_scale_of_values(spark):
    rng = random.Random(1)
    values = [0.001] * 300 + [rng.random() for _ in range(50)] + [1e9 + k for k in range(50)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, ms double")
    row = EV.latency_percentiles(df, ["k"]).first()
    ordered, n = sorted(values), len(values)
    assert row.p50 == round((ordered[(n - 1) // 2] + ordered[n // 2]) / 2, 2) and row.p95 == round(ordered[round(0.95 * (n - 1))], 2)


def plain_moves(events):
    now, out = {}, []
    for job, ts, seq, state in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2])):
        before = now.get(job)
        legal = state == "queued" if before is None else state in LE.LEGAL[before]
        if legal:
            now[job] = state
        out.append((job, seq, state, before, legal))
    return out


@pytest.mark.parametrize("rows", [7, 500_000])
def test_the_state_left_by_the_last_legal_move(spark, rows):
    rng = random.Random(3)
    states = [*LE.LEGAL, "unknown", None]
    t0 = dt.datetime(2026, 1, 1)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), t0 + dt.timedelta(minutes=rng.randrange(60)), k, rng.choice(states[: rng.choice([4, 8])])) for k in range(400)]
    events.insert(0, (1, t0, -1, "queued"))
    df = spark.createDataFrame(events, "job_id long, ts timestamp, seq long, state string").withColumn("note", F.lit("x"))
    got = LE.transitions(df, rows)
    assert got.columns == ["job_id", "ts", "seq", "state", "note", "previous", "legal"]
    key = lambda r: r[1]
    assert sorted([(r.job_id, r.seq, r.state, r.previous, r.legal) for r in got.collect()], key=key) == sorted(plain_moves(events), key=key)
    assert LE.transitions(df.limit(0), rows).count() == 0


def test_batches_number_lines_not_rows(rows):
    from lorekeep.operators import prompts

    packed = prompts.batched_prompts(rows([(f"d{k}", f"{k} text") for k in range(45)], "note_id string, text string"), "note_id", F.substring("text", 1, 3), 20)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("substring(") > plan.index("Window") and [r.n for r in packed.orderBy("batch").collect()] == [20, 20, 5]
