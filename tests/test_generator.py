"""Logs from counters, plots of bounded size, and the short and the long way through a log line."""

import random

import pytest
from pyspark.sql import functions as F

from buswright import demo
from buswright.operators import decode, summaries
from buswright.sources import candump, generator
from buswright.sources.dbc import parse

WIDE = 'BO_ 7 Fd: 12 N\n SG_ A : 60|16@1+ (1,0) [0|0] "" L\n SG_ B : 87|9@0+ (1,0) [0|0] "" L\n SG_ S M : 0|2@1+ (1,0) [0|0] "" L\n SG_ P m1 : 8|9@0+ (1,0) [0|0] "" L\n SG_ Q m3 : 8|9@1+ (1,0) [0|0] "" L\nBO_ 8 None: 2 N\n'


@pytest.mark.parametrize("catalog", [demo.catalog(), parse(WIDE)], ids=["demo", "wide"])
def test_generated_frames_decode_to_their_waves(spark, catalog):
    counters = spark.createDataFrame([(s, n) for s in (0, 5, 10**6) for n in range(160)], "seed long, n long")
    frames = generator.generate(counters, catalog, start_us=500, step_us=250)
    got = {}
    for seed in (0, 5, 10**6):
        for r in decode.decode_frames(frames.where(F.col("seed") == seed), catalog).collect():
            assert r.status == "ok" and r.ts_us == 500 + 250 * r.seq
            got[seed, r.seq, r.signal] = r.raw
    sent, want = generator.sent(catalog), {}
    for seed in (0, 5, 10**6):
        for n in range(160):
            m, turn = sent[n % len(sent)], n // len(sent)
            shown = generator.pages(m)
            page = shown[(seed + turn) % len(shown)] if shown else None
            for s in m.signals:
                top, a, b, c = generator.wave(m.name, s.name, s.length)
                if s.mux_kind == "M":
                    want[seed, n, s.name] = page
                elif s.mux_kind != "m" or s.mux_page == page:
                    want[seed, n, s.name] = abs((seed * a + turn * b + c) % (2 * top) - top)
    assert got == want


def test_a_long_log_is_the_same_on_every_run_and_any_tasks(spark):
    digest = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(seq, ts_us, can_id, payload))")).first()
    of = lambda parts: generator.generate(spark.range(0, 200_000, 1, parts).selectExpr("7L AS seed", "id AS n"), demo.catalog())
    one = digest(of(1))
    assert one[0] == 200_000 and digest(of(9)) == one and digest(of(4).orderBy(F.desc("seq"))) == one
    assert digest(generator.generate(spark.range(200_000).selectExpr("8L AS seed", "id AS n"), demo.catalog())) != one
    with pytest.raises(ValueError, match="nothing to send"):
        generator.generate(spark.range(1).selectExpr("1L AS seed", "id AS n"), parse("BO_ 8 None: 2 N\n"))


def test_a_panel_is_bounded_and_keeps_the_extremes(spark):
    r = random.Random(4)
    rows = [("M", s, r.randrange(0, 10**6), i, r.gauss(0, 9), "ok") for i in range(900) for s in ("A", "B")] + [("M", "A", 5, 9999, None, "unfit"), ("M", "A", -1, 1, 999.0, "ok")]
    d = spark.createDataFrame(rows, "message string, signal string, ts_us long, seq long, value double, status string").repartition(3)
    got = {(x.signal, x.column): tuple(x)[3:] for x in summaries.panels(d, 0, 999_999, 70).collect()}
    want = {}
    for _, s, t, n, v, ok in sorted(rows, key=lambda x: x[2:4]):
        if ok == "ok" and t >= 0:
            want.setdefault((s, t // (999_999 // 70 + 1)), []).append(v)
    assert got == {k: (len(v), min(v), max(v), v[0], v[-1]) for k, v in want.items()} and max(c for _, c in got) < 70
    assert [(x.column, x.n) for x in summaries.panels(d.where("seq = 1 AND ts_us < 0"), -1, -1, 5).collect()] == [(0, 1)]


def test_lines_cut_by_position_are_what_the_rules_make_of_them(spark):
    r = random.Random(5)
    hexed = lambda n: "".join(r.choice("0123456789abcdefABCDEF") for _ in range(n))
    lines = []
    for _ in range(600):
        stamp = f"({r.randrange(10 ** r.randrange(1, 13))}.{r.randrange(10**6):06d})"
        name = r.choice([r.choice("01234567") + hexed(2), r.choice("01") + hexed(7)])
        data = r.choice(["#" + hexed(2 * r.randrange(0, 9)), "##" + hexed(1) + hexed(2 * r.choice([*range(9), 12, 16, 20, 24, 32, 48, 64]))])
        lines.append(f"{stamp} {r.choice(['can0', 'v.can-7', 'x(y)'])} {name}{data}")
    line = F.col("line")
    d = spark.createDataFrame([(x,) for x in lines], "line string")
    assert d.where(~line.rlike(candump._PLAIN)).count() == 0
    assert d.where(candump._plain_line(line) != candump._odd_line(line)).count() == 0
    both = d.select(candump._plain_line(line).alias("p"), candump._odd_line(line).alias("o")).collect()
    assert all(x.p == x.o and x.p.kind == "frame" for x in both)
    # what is not plain goes by the rules, and says no other thing than they do
    odd = [x[:k] + c + x[k + 1 :] for x in lines[:200] for k, c in [(r.randrange(len(x)), r.choice(" #(_.Rz\té"))]]
    d = spark.createDataFrame([(x,) for x in odd], "line string")
    got = [tuple(x)[1:] for x in candump.parse_lines(d).collect()]
    assert got == [tuple(x.o) for x in d.select(candump._odd_line(line).alias("o")).collect()] and len({x[0] for x in got}) == 3
