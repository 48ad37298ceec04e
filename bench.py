"""Times the headline queries and prints one line of JSON.

Each query is run once to warm up and then timed, its result written to a sink
that keeps nothing. ``rates`` are rows a second: frames and signals decoded, log
lines read from files, and grid points resampled on a grid of millions, over as
many cores as ``cpus`` says, from files that aren't cached.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buswright import demo
from buswright import queries as q
from buswright.operators import resample
from buswright.operators.decode import decode_frames
from buswright.plans import compiled
from buswright.session import scratch, session
from buswright.sources.candump import log_line, parse_lines, read_log

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = ["decode_frame_long", "decode_compiled_long", "decode_tally", "candump_render_parse", "extract_nine_byte", "insert_round_trip", "render_csv_row", "check_overlap", "resample_hold", "resample_backfill", "channel_summary", "monotonic_violations"]

#: Points of the grid on which resampling is timed, for each identifier.
POINTS = 5_000_000


def timed(df: DataFrame | Callable[[], DataFrame]) -> float:
    """Seconds for all rows; of a function also what it does to make its result."""
    start = time.perf_counter()
    df = df() if callable(df) else df
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def bulk_frames(spark: SparkSession) -> DataFrame:
    """Frames in the volume of lineitem: six for each of its rows."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    types = F.array(*[F.lit(t) for t in ("click", "purchase", "view", "signup", "error")])
    rows = lines.select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("n"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("ts"), "l_partkey").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    events = rows.select((F.col("n") * 6 + F.col("copy")).alias("event_id"), "ts", F.col("l_partkey").alias("user_id"), F.element_at(types, (F.pmod("n", F.lit(5)) + 1).cast("int")).alias("event_type"), "value")
    # the table is one row group, which one task reads
    return demo.frames(events.repartition(CPUS))


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=str(CPUS), spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = partial(q.QUERIES[name], spark, SF_DIR)
        timed(run)
        seconds[name] = round(timed(run), 3)

    path = scratch(spark, "bench-frames")
    bulk_frames(spark).write.parquet(path)
    frames = spark.read.parquet(path)
    count = frames.count()
    base = timed(frames)
    rates = {}
    for name, df, rows in (("signals_decoded", decode_frames(frames, demo.catalog()), None), ("signals_decoded_compiled", compiled.long(frames, demo.catalog()), None)):
        timed(df)
        rows, took = df.count(), timed(df)
        rates[f"{name}_per_s"] = round(rows / took)
        rates[f"frames_for_{name}_per_s"] = round(count / took)
    lines = frames.select(log_line(F.col("ts_us"), F.col("can_id"), F.col("is_extended"), F.col("payload"), F.col("len8_dlc")).alias("line"))
    took = timed(parse_lines(lines))
    rates["log_lines_written_and_parsed_per_s"] = round(count / took)
    logs = scratch(spark, "bench-logs")
    lines.write.text(logs)
    rates["log_lines_read_per_s"] = round(count / timed(lambda: read_log(spark, logs)[0]))
    about = resample.span(frames).first()
    step = (about.end_us - about.start_us) // POINTS + 1
    index = F.call_function("div", F.col("ts_us") - F.lit(about.start_us - step + 1), F.lit(step))
    held = resample.hold(frames.select("can_id", "ts_us", "seq"), ["can_id"], index, POINTS, "seq", ("ts_us",))
    points, took = held.count(), timed(held)
    rates["grid_points_per_s"] = round(points / took)
    rates["frames"], rates["reading_frames_s"] = count, round(base, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": rates, "cpus": CPUS, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
