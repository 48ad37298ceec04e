"""Resampling by tiles: the same samples whatever the tiles, grids of any length, and pieces of files."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buswright.operators import resample
from buswright.sinks import ld


def updates_of(spark, rows):
    return spark.createDataFrame([(c, t, i, float(v)) for i, (c, t, v) in enumerate(rows)], "c string, ts_us long, seq long, value double").repartition(3)


def plain(rows, points):
    out = {}
    for c in {c for c, _, _ in rows}:
        mine = sorted(((t, i, v) for i, (x, t, v) in enumerate(rows) if x == c))
        held, n = mine[0][2], 0
        for k in range(points):
            while n < len(mine) and mine[n][0] <= k * 10:
                held, n = mine[n][2], n + 1
            out[c, k] = float(held)
    return out


def index():
    return F.expr("(ts_us + 9) div 10")


@pytest.mark.parametrize("tile", [1, 4, 16, 1 << 16])
def test_tiles_of_any_size_hold_the_same_values(spark, monkeypatch, tile):
    monkeypatch.setattr(resample, "TILE", tile)
    r = random.Random(tile)
    rows = [("dense", r.randrange(-20, 700), r.random()) for _ in range(90)] + [("sparse", t, n) for n, t in enumerate((213, 214, 610))]
    rows += [("late", 990, 1), ("late", 2000, 2), ("beyond", 5000, 3), ("early", -50, 4), ("early", -60, 5), ("ties", 30, 6), ("ties", 30, 7), ("ties", 640, 8)]
    points = 67
    got = resample.runs(updates_of(spark, rows), ["c"], index(), points).collect()
    assert all(0 <= x.lo <= x.hi < points and x.lo // tile == x.hi // tile == x.tile for x in got)
    flat = [((x.c, k), x.value) for x in got for k in range(x.lo, x.hi + 1)]
    assert len(flat) == len(dict(flat)) and dict(flat) == plain(rows, points)
    held = resample.hold(updates_of(spark, rows), ["c"], index(), points)
    assert {(x.c, x.k): x.value for x in held.collect()} == plain(rows, points)


def test_runs_and_carried_values_share_one_exchange(spark):
    df = resample.runs(updates_of(spark, [("a", 5, 1), ("a", 900, 2)]), ["c"], index(), 100)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_a_grid_of_billions_of_points_is_expanded(spark):
    points = 3_000_000_000
    held = resample.hold(updates_of(spark, [("a", 0, 1), ("a", 10 * (points - 1), 2)]), ["c"], index(), points)
    assert held.agg(F.count(F.lit(1)), F.max("k"), F.sum("value")).first() == (points, points - 1, float(points + 1))


def test_pieces_of_a_file_are_put_together_in_order(spark, monkeypatch):
    monkeypatch.setattr(resample, "TILE", 8)
    rows = [(c, t * 10, v) for c, t, v in [("0", 3, 1), ("0", 20, 2), ("1", 0, 5), ("1", 17, 6), ("1", 39, 7)]]
    runs = resample.runs(updates_of(spark, rows), ["c"], index(), 41, "value").select(F.col("c").cast("int").alias("channel_ix"), "tile", "lo", "hi", F.col("value").cast("float").alias("sample"))
    sampled = resample.Sampled(runs, [(0, "A", ""), (1, "B", "")], 0, 100, 41, 5, 0)
    out = io.BytesIO()
    assert ld.write_ld(sampled, out) == len(out.getvalue()) == 1762 + 1154 + 2 * 124 + 2 * 41 * 4
    want = plain(rows, 41)
    got = ld.read_samples(out.getvalue())
    assert {(c, k): float(v) for c, name in (("0", "A"), ("1", "B")) for k, v in enumerate(got[name])} == want
    assert max(r.points for r in ld.packed_tiles(runs).collect()) == 8
    for bad in (runs.where("tile != 2"), runs.where("channel_ix = 0"), runs.where("channel_ix = 1"), runs.where("NOT (channel_ix = 1 AND tile = 5)")):
        with pytest.raises(ValueError, match="carries .* samples but the session has 41"):
            ld.write_ld(resample.Sampled(bad, sampled.channels, 0, 100, 41, 5, 0), io.BytesIO())
    with pytest.raises(Exception, match="leave points out"):
        ld.packed_tiles(runs.unionByName(runs)).collect()
    assert np.isfinite(got["A"]).all()
