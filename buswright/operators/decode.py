"""Frames to physical values.

The join with the catalog is one hash lookup a frame, the rest of the plan is a
projection: nothing is shuffled. A frame's payload becomes words once, before the
join; where a field lies in them is worked out once for each row of the catalog, so a
signal is a few shifts. The catalog's rows carry the layout of their message's
multiplexor, so a frame's selector is read in the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.functions.bits import payload_words, placed_raw, placement
from buswright.functions.values import label, scale
from buswright.sources.dbc import Catalog

#: Signals of a catalog that is sent to all tasks, some 30 MB; a larger one is joined by a shuffle.
BROADCAST_SIGNALS = 100_000

_KEY = ["can_id", "is_extended"]


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_SIGNALS else table


def decode_frames(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """One row for each signal that a frame carries, as :data:`buswright.schemas.DECODED`.

    Signals of another page than the one that the frame's multiplexor selects have
    no row. A signal that the payload is too short for has status 'unfit', and if
    it is the multiplexor no page is selected. Frames that the catalog doesn't have
    are dropped. Frames may be a stream.
    """
    signals = catalog.signals(frames.sparkSession)
    return decode_with(frames, signals, catalog.signal_count)


def _laid_out(signals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What decoding needs of a table of signals, with the places of each and of its page's selector, and the columns to keep."""
    paged = F.col("has_mux") & F.coalesce(F.col("mux_kind") == "m", F.lit(False))
    return signals.select(
        *_KEY, "message", "sig_ix", "signal", "length", "is_signed", "factor", "offset", "unit", "labels", "required",
        placement(F.col("start_bit"), F.col("length"), F.col("is_motorola")).alias("place"),
        paged.alias("paged"), "mux_page", "mux_required",
        F.when(paged, placement(F.col("mux_start"), F.col("mux_length"), F.col("mux_motorola"))).alias("mux_place"), *keep,
    )


def decode_with(frames: DataFrame, signals: DataFrame, count: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`decode_frames` with a table of signals, such as one of many databases.

    Up to :data:`BROADCAST_SIGNALS` of them are sent to all tasks; where ``count``
    isn't given Spark judges by their size. Columns of ``signals`` named in ``keep``
    come last in the result.
    """
    at = frames.select("seq", "ts_us", *_KEY, F.length("payload").alias("available"), payload_words(F.col("payload")).alias("words"))
    laid = _laid_out(signals, keep)
    at = at.join(laid if count is None else small(laid, count), _KEY)
    selected = (F.col("mux_required") <= F.col("available")) & (placed_raw(F.col("words"), F.col("mux_place")) == F.col("mux_page"))
    at = at.where(~F.col("paged") | F.coalesce(selected, F.lit(False)))
    at = at.withColumn("raw", F.when(F.col("required") <= F.col("available"), placed_raw(F.col("words"), F.col("place"))))
    return at.select(
        "seq", "ts_us", *_KEY, "message", "sig_ix", "signal", "raw",
        scale(F.col("raw"), F.col("length"), F.col("is_signed"), F.col("factor"), F.col("offset")).alias("value"),
        "unit",
        label(F.col("raw"), F.col("length"), F.col("is_signed"), F.col("labels")).alias("label"),
        F.when(F.col("raw").isNull(), "unfit").otherwise("ok").alias("status"),
        "required", "available", *keep,
    )


def unknown_frames(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Frames whose identifier the catalog doesn't have."""
    return frames.join(small(catalog.messages(frames.sparkSession), len(catalog)).select(*_KEY), _KEY, "left_anti")


def known_frames(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Frames that the catalog has, with message and n_signals, also those of messages without signals."""
    return frames.join(small(catalog.messages(frames.sparkSession), len(catalog)).select(*_KEY, "message", "n_signals"), _KEY)


def tally(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """One row: frames that were decoded, frames not in the catalog and signals that did not fit.

    One pass: frames meet each message's signals as an array, of which the unfit
    are counted in place.
    """
    spark = frames.sparkSession
    laid = _laid_out(catalog.signals(spark))
    layouts = laid.groupBy(*_KEY).agg(F.collect_list(F.struct("paged", "mux_page", "required")).alias("signals"), F.max("mux_place").alias("mux"), F.max("mux_required").alias("mux_required"))
    known = catalog.messages(spark).select(*_KEY, F.lit(True).alias("known")).join(layouts, _KEY, "left")
    at = frames.select(*_KEY, F.length("payload").alias("size"), payload_words(F.col("payload")).alias("words"))
    at = at.join(small(known, catalog.signal_count), _KEY, "left")
    size = F.col("size")
    at = at.withColumn("selector", F.when(F.col("mux_required") <= size, placed_raw(F.col("words"), F.col("mux"))))

    def unfit(s: Column) -> Column:
        return (s["required"] > size) & (~s["paged"] | F.coalesce(F.col("selector") == s["mux_page"], F.lit(False)))

    return at.agg(
        F.count_if(F.col("known")).alias("frames"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("signals").isNotNull(), F.size(F.filter("signals", unfit)))), F.lit(0)).cast("long").alias("unfit"),
    )
