import random

import pytest
from pyspark.sql import functions as F

from buswright.functions import bits, values


def positions(start, length, motorola):
    """A field's bits from its start bit on, walked one by one."""
    at = start
    for _ in range(length):
        yield at
        at = at + 1 if not motorola else (at + 15 if at % 8 == 0 else at - 1)


def walk(payload, start, length, motorola):
    out = 0
    for i, p in enumerate(positions(start, length, motorola)):
        if p // 8 >= len(payload):
            return None
        bit = payload[p // 8] >> (p % 8) & 1
        out = out << 1 | bit if motorola else out | bit << i
    return out


def wrap(x):
    return x - (1 << 64) if x is not None and x >= 1 << 63 else x


def layouts(count, seed):
    r = random.Random(seed)
    for i in range(count):
        n = r.randint(0, 64)
        yield i, r.randbytes(n), r.randint(0, max(8 * n - 1, 8)), r.choice([1, 7, 8, 12, 16, 31, 32, 33, 57, 63, 64, r.randint(1, 64)]), r.random() < 0.5, r.getrandbits(64)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, p, s, n, m, wrap(x), wrap(x & ((1 << n) - 1))) for i, p, s, n, m, x in layouts(8000, 1)]
    return spark.createDataFrame(rows, "i int, p binary, s int, n int, m boolean, x bigint, y bigint").persist(), {r[0]: r for r in rows}


def test_extraction_is_a_walk_over_bits(table):
    df, rows = table
    fit = 0
    for r in df.select("i", bits.extract_raw(F.col("p"), F.col("s"), F.col("n"), F.col("m")).alias("raw"), bits.required_bytes(F.col("s"), F.col("n"), F.col("m")).alias("need")).collect():
        _, p, s, n, m, _, _ = rows[r.i]
        want = wrap(walk(p, s, n, m))
        assert r.raw == want, rows[r.i]
        assert r.need == max(q // 8 for q in positions(s, n, m)) + 1
        fit += want is not None
    assert fit > 2000


def test_insertion_sets_the_field_and_nothing_else(table):
    df, rows = table
    args = (F.col("p"), F.col("s"), F.col("n"), F.col("m"))
    ok = 0
    for r in df.select("i", bits.insert_raw(*args, F.col("y")).alias("out"), bits.insert_status(*args, F.col("y")).alias("st"), bits.insert_status(*args, F.col("x")).alias("wide")).collect():
        _, p, s, n, m, x, y = rows[r.i]
        own = list(positions(s, n, m))
        fits = all(q // 8 < len(p) for q in own)
        assert r.st == ("ok" if fits else "out_of_bounds")
        assert (r.wide == "raw_out_of_range") == ((x % (1 << 64)) >> n > 0)
        if not fits:
            assert bytes(r.out) == p
            continue
        want, ok = bytearray(p), ok + 1
        for i, q in enumerate(own):
            bit = (y % (1 << 64)) >> (n - 1 - i if m else i) & 1
            want[q // 8] = want[q // 8] & ~(1 << q % 8) | bit << q % 8
        assert bytes(r.out) == bytes(want), rows[r.i]
    assert ok > 2000


def test_literal_layouts_give_what_columns_give(spark):
    p = spark.createDataFrame([(bytes(range(1, 17)),)], "p binary")
    shapes = [(s, n, m) for s in (0, 3, 4, 7, 11, 15) for n in (1, 8, 13, 32, 57, 64) for m in (False, True)]
    row = p.select(*[bits.extract_raw(F.col("p"), *x).alias(f"l{i}") for i, x in enumerate(shapes)], *[bits.extract_raw(F.col("p"), *map(F.lit, x)).alias(f"c{i}") for i, x in enumerate(shapes)]).first()
    for i, x in enumerate(shapes):
        assert row[f"l{i}"] == row[f"c{i}"] == wrap(walk(bytes(range(1, 17)), *x)), x


@pytest.mark.parametrize(
    ("value", "length", "signed", "factor", "offset", "want"),
    [
        (10.0, 8, False, 0.5, -40.0, 100), (-0.1, 16, True, 0.1, 0.0, 65535), (2.5, 8, False, 1.0, 0.0, 3), (-2.5, 8, True, 1.0, 0.0, 253), (256.0, 8, False, 1.0, 0.0, None), (-1.0, 8, False, 1.0, 0.0, None),
        (128.0, 8, True, 1.0, 0.0, None), (-128.0, 8, True, 1.0, 0.0, 128), (float("nan"), 8, False, 1.0, 0.0, None), (float("inf"), 64, False, 1.0, 0.0, None), (1.0, 8, False, 0.0, 0.0, None),
        (18446744073709549568.0, 64, False, 1.0, 0.0, -2048), (18446744073709551616.0, 64, False, 1.0, 0.0, None), (9223372036854775808.0, 64, False, 1.0, 0.0, -(1 << 63)), (-9223372036854775808.0, 64, True, 1.0, 0.0, -(1 << 63)),
        (4503599627370497.0, 64, False, 1.0, 0.0, 4503599627370497), (0.49999999999999994, 8, False, 1.0, 0.0, 0),
    ],
)
def test_unscaling(spark, value, length, signed, factor, offset, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(values.unscale(F.col("v"), length, signed, factor, offset).alias("r")).first().r == want


def test_scaling_and_labels_at_the_ends_of_64_bits(spark):
    df = spark.createDataFrame([(-1,), (0,), (-(1 << 63),)], "r bigint")
    got = df.select(values.unsigned_double(F.col("r")).alias("d"), values.unsigned_text(F.col("r")).alias("t"), values.scale(F.col("r"), 64, True, 1.0, 0.0).alias("s"), values.label(F.col("r"), 64, False, F.create_map(F.lit(-1).cast("long"), F.lit("x"))).alias("u"), values.label(F.col("r"), 64, True, F.create_map(F.lit(-1).cast("long"), F.lit("x"))).alias("l")).collect()
    assert [(r.d, r.t, r.s) for r in got] == [(float(2**64 - 1), str(2**64 - 1), -1.0), (0.0, "0", 0.0), (float(2**63), str(2**63), -float(2**63))]
    assert [r.u for r in got] == [None] * 3 and [r.l for r in got] == ["x", None, None]
