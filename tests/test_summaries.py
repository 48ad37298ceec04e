"""Series, violations and channel summaries against plain loops, on bursts, ties and few or many distinct values."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from buswright.operators import summaries

SCHEMA = "message string, signal string, ts_us long, seq long, value double, status string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def burst(n=400):
    r = random.Random(8)
    rows = [("M", "Burst", 1000 + i // 7, i, float(r.randrange(9)), "ok") for i in range(n)]  # ties in time, all but one at once
    rows += [("M", "Burst", 10**15, n, 1.0, "ok"), ("M", "Same", 5, 9, 1.0, "ok"), ("N", "Burst", 1000, 7, 2.0, "ok"), ("M", "Burst", 1001, 99, None, "unfit")]
    rows += [("M", "Down", 3 * i, 10_000 - i, float(-i), "ok") for i in range(50)]
    return rows


def by_signal(rows):
    out = {}
    for m, s, t, n, v, status in rows:
        if status == "ok":
            out.setdefault((m, s), []).append((t, n, v))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("ranges", "piece"), [(25, 7), (60, 60), (10_000, 1000)])
def test_ranges_of_a_burst_are_of_equal_depth(spark, monkeypatch, ranges, piece):
    monkeypatch.setattr(summaries, "RANGE_ROWS", ranges)
    monkeypatch.setattr(summaries, "PIECE_ROWS", piece)
    rows = burst()
    d = frame(spark, rows)
    sizes = [r["count"] for r in summaries._in_order(d).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) - 1 and max(sizes) <= 2 * ranges
    want = by_signal(rows)
    got = {}
    for r in sorted(summaries.series(d).collect(), key=lambda r: (r.message, r.signal, r.piece)):
        mine = got.setdefault((r.message, r.signal), [])
        assert r.piece == len(mine) and 0 < len(r.value) <= piece
        mine.append(list(zip(r.ts_us, r.value, strict=True)))
    assert {k: sum(v, []) for k, v in got.items()} == {k: [(t, x) for t, _, x in v] for k, v in want.items()}
    lower = sorted((m, s, n, t, b, v) for (m, s), held in want.items() for (_, _, b), (t, n, v) in pairwise(held) if v < b)
    assert sorted(tuple(r) for r in summaries.monotonic_violations(d).collect()) == lower and len(lower) > 150


def test_no_values_have_no_pieces_and_no_violations(spark):
    d = frame(spark, [("M", "A", 1, 1, None, "unfit")])
    assert summaries.series(d).collect() == [] and summaries.monotonic_violations(d).collect() == [] and summaries.channel_summary(d).collect() == []


def test_steps_are_counted_exactly_up_to_their_bound(spark):
    r = random.Random(9)
    rows, want = [], {}
    for k in range(120):
        whole = k % 4 > 0
        pool = [float(r.randrange(-(10 ** r.randrange(1, 13)), 10 ** r.randrange(1, 13))) + (0 if whole else 0.5) for _ in range(r.choice([1, 2, 5, 11, 12, 13, 14, 40]))]
        values = [r.choice(pool) for _ in range(r.choice([3, 60, 400]))]
        rows += [("M", f"S{k}", i, i, v, "ok") for i, v in enumerate(values)]
        peak = max(enumerate(values), key=lambda x: (abs(x[1]), -x[0]))[1]
        want[f"S{k}"] = (len(values), min(values), max(values), peak, whole and len(set(values)) <= 12)
    df = summaries.channel_summary(frame(spark, rows, 7))
    assert {r.signal: tuple(r)[2:] for r in df.collect()} == want
    assert {x[4] for x in want.values()} == {True, False}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") <= 2
