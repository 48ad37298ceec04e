"""Queries against the SQL that they equal, on the small tables where these are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    show = lambda v: f"{v:.12g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_the_flagship_query_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_decoding_needs_no_shuffle(spark):
    plan = entry.queries()["decode_frame_long"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_stream_of_part_files_is_decoded_without_the_driver(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    name = "stream_decode_equals_batch"
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert got and plain(got) == plain(entry.queries()[name](spark, SF).collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("decoded_")]
