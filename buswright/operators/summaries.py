"""Aggregates over decoded signals and catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buswright.operators.decode import small
from buswright.session import scratch

#: Values of a range, about (none has twice as many), and of a piece of a series, at the most.
RANGE_ROWS, PIECE_ROWS = 100_000, 100_000
#: Values that a channel may have at the most to be drawn in steps.
STEPS = 12
_ORDER = ["message", "signal", "ts_us", "seq"]


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the folder that executors share, so that what made it runs once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_order(decoded: DataFrame) -> DataFrame:
    """Values by signal and time, sorted within ranges of about :data:`RANGE_ROWS` values, a task each.

    Edges of the ranges come from a sample of the values themselves, so a burst is
    as many ranges as its values need, and a signal without values takes none.
    """
    ok = _written(decoded.where("status = 'ok'").select(*_ORDER, "value"), "ordered-values")
    ranges = max(1, -(-ok.count() // RANGE_ROWS))
    return ok.repartitionByRange(ranges, *_ORDER).sortWithinPartitions(*_ORDER)


def _same_signal(batch: pa.RecordBatch) -> np.ndarray:
    """For each row but the first of a batch whether it is of the signal of the row before."""
    same = np.ones(max(batch.num_rows - 1, 0), bool)
    for name in ("message", "signal"):
        column = batch.column(name)
        same &= np.asarray(pc.equal(column[1:], column[:-1]).fill_null(False))
    return same


def _signal_of(batch: pa.RecordBatch, row: int) -> tuple[str, str]:
    return batch.column("message")[row].as_py(), batch.column("signal")[row].as_py()


def series(decoded: DataFrame) -> DataFrame:
    """Each signal's values in time order, a row for each piece: message, signal, piece, ts_us array, value array.

    Pieces are numbered from 0 and have ``PIECE_ROWS`` values at the most.
    """
    schema = pa.schema([("message", pa.string()), ("signal", pa.string()), ("range", pa.int64()), ("own", pa.int64()), ("ts_us", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own, number = TaskContext.get().partitionId(), [], 0, None

        def piece() -> pa.RecordBatch:
            columns = [pa.array([np.concatenate(c)]) for c in zip(*held, strict=True)]
            return pa.record_batch([[number[0]], [number[1]], [at], [own], *columns], schema=schema)

        for batch in batches:
            ts, value = batch.column("ts_us").to_numpy(), batch.column("value").to_numpy()
            edges = [0, *(np.flatnonzero(~_same_signal(batch)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b and _signal_of(batch, a) != number:
                    if held:
                        yield piece()
                    held, own, number = [], 0, _signal_of(batch, a)
                while a < b:
                    stop = min(b, a + PIECE_ROWS - sum(len(t) for t, _ in held))
                    held.append((ts[a:stop], value[a:stop]))
                    a = stop
                    if sum(len(t) for t, _ in held) == PIECE_ROWS:
                        yield piece()
                        held, own = [], own + 1
        if held:
            yield piece()

    pieces = _written(_in_order(decoded).mapInArrow(cut, "message string, signal string, range long, own long, ts_us array<bigint>, value array<double>"), "series-pieces")
    counts = pieces.groupBy("message", "signal", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("message", "signal").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each signal of a range
    offsets = _written(counts.select("message", "signal", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "series-offsets")
    placed = pieces.join(small(offsets, offsets.count()), ["message", "signal", "range"])
    return placed.select("message", "signal", (F.col("before") + F.col("own")).alias("piece"), "ts_us", "value")


def frame_count(decoded: DataFrame) -> DataFrame:
    """One row: distinct frames, by timestamp and identifier, that gave a value."""
    return decoded.where("status = 'ok'").agg(F.count_distinct("ts_us", "can_id", "is_extended").alias("frames"))


def channel_summary(decoded: DataFrame) -> DataFrame:
    """A row a signal: n, minimum, maximum, peak (the value of largest magnitude, the first of equals) and stepped
    (all values whole, :data:`STEPS` of them distinct at most).

    Distinct values are counted up to one more than that: a histogram of so many
    bins keeps each distinct value in bins of its own while there are no more, and
    merges bins of equal values before any others. So a signal takes one small
    buffer a task, and no value is shuffled.
    """
    ok = decoded.where("status = 'ok'")
    # whole values that a merge has averaged are rounded back to what they were
    distinct = F.size(F.array_distinct(F.transform("bins", lambda b: F.rint(b["x"]))))
    out = ok.groupBy("message", "signal").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.max_by("value", F.struct(F.abs("value").alias("a"), (-F.col("seq")).alias("b"))).alias("peak"),
        F.bool_and(F.col("value") == F.floor("value")).alias("whole"),
        F.histogram_numeric("value", F.lit(STEPS + 1)).alias("bins"),
    )
    return out.select("message", "signal", "n", "minimum", "maximum", "peak", (F.col("whole") & (distinct <= STEPS)).alias("stepped"))


def monotonic_violations(decoded: DataFrame) -> DataFrame:
    """A row for each value of a signal that is less than the one before it."""
    names = ["message", "signal", "seq", "ts_us", "before", "value"]
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("message", pa.string()), ("signal", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("before", pa.float64()), ("value", pa.float64())])

    def rows(batch: pa.RecordBatch, at: np.ndarray, kind: int, before: np.ndarray | None = None) -> pa.RecordBatch:
        part = batch.take(pa.array(at))
        held = {**{c: part.column(c) for c in ("message", "signal", "seq", "ts_us", "value")}, "kind": pa.array(np.full(len(at), kind, np.int32)), "range": pa.array(np.full(len(at), TaskContext.get().partitionId()))}
        held["before"] = pa.nulls(len(at), pa.float64()) if before is None else pa.array(before)
        return pa.record_batch([held[f.name] for f in schema], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.concat_batches([last, batch])
            value = batch.column("value").to_numpy()
            same = _same_signal(batch)
            lower = np.flatnonzero(same & (value[1:] < value[:-1]))
            yield rows(batch, lower + 1, 0, value[lower])
            # the first and last value of each signal of the range, which the ranges beside it need
            if last is None:
                yield rows(batch, np.zeros(1, np.int64), 1)
            edges = np.flatnonzero(~same)
            yield rows(batch, edges, 2)
            yield rows(batch, edges + 1, 1)
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield rows(last, np.zeros(1, np.int64), 2)

    found = _in_order(decoded).mapInArrow(walk, "kind int, range long, message string, signal string, seq long, ts_us long, before double, value double")
    found = _written(found, "violations")
    order = Window.partitionBy("message", "signal").orderBy("range", "kind")
    edges = found.where("kind > 0").withColumn("before", F.lag("value").over(order)).where("kind = 1 AND value < before")
    return found.where("kind = 0").select(*names).unionByName(edges.select(*names))


def panels(decoded: DataFrame, start_us: int, end_us: int, columns: int) -> DataFrame:
    """What a plot of each signal over a span needs, in pixel columns: message, signal, column, n, minimum, maximum, first, last.

    One aggregate, and at most ``columns`` rows a signal however long the log: a
    line through first, minimum, maximum and last of each column looks as one
    through all values. Columns without values have no row.
    """
    width = (end_us - start_us) // columns + 1
    at, order = F.call_function("div", F.col("ts_us") - F.lit(start_us), F.lit(width)), F.struct("ts_us", "seq")
    inside = decoded.where("status = 'ok'").where(F.col("ts_us").between(start_us, end_us))
    return inside.groupBy("message", "signal", at.alias("column")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last")
    )


def carried_signals(decoded: DataFrame) -> DataFrame:
    """The distinct (can_id, signal) that gave a value."""
    return decoded.where("status = 'ok'").select("can_id", "signal").distinct()


def catalog_features(messages: DataFrame, signals: DataFrame) -> DataFrame:
    """A row a database: messages, extended messages, signals, Motorola, signed and paged signals, distinct widths."""
    a = messages.groupBy("db").agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_extended").alias("extended"))
    b = signals.groupBy("db").agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_if("is_motorola").alias("motorola"),
        F.count_if("is_signed").alias("signed"),
        F.count_if(F.col("mux_kind") == "m").alias("paged"),
        F.count_distinct("length").alias("widths"),
    )
    return a.join(b, "db", "left").fillna(0)


def corpus_report(messages: DataFrame, signals: DataFrame, errors: DataFrame) -> DataFrame:
    """A row a database file by name: db, messages, signals, paged (signals of a page) and error, null where it could be read."""
    m = messages.groupBy("db").agg(F.count(F.lit(1)).alias("messages"))
    s = signals.groupBy("db").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("mux_kind") == "m").alias("paged"))
    read = m.join(s, "db", "left").fillna(0).withColumn("error", F.lit(None).cast("string"))
    none = [F.lit(0).cast("long").alias(c) for c in ("messages", "signals", "paged")]
    return read.unionByName(errors.select("db", *none, "error")).orderBy("db")
