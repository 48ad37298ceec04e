"""Layout problems of databases, as joins of their signals byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.sources.dbc import Catalog

#: Bytes of the longest payload; bits past it are in no frame and aren't compared.
_BYTES = 64
#: The slot of signals of no page; pages are at least 0.
_NO_PAGE = -1


def _bytes() -> Column:
    """The bytes that a signal has bits in, with a mask of them. Places count as the byte order goes: from a byte's lowest bit, or its highest."""
    start, length = F.col("start_bit"), F.col("length")
    first = F.when(F.col("is_motorola"), start + 7 - 2 * (start % 8)).otherwise(start)
    last = first + length - 1
    held = F.sequence(F.least(F.call_function("div", first, F.lit(8)), F.lit(_BYTES)).cast("int"), F.least(F.call_function("div", last, F.lit(8)), F.lit(_BYTES)).cast("int"))

    def mask(byte: Column) -> Column:
        low, high = F.greatest(first - byte * 8, F.lit(0)), F.least(last - byte * 8, F.lit(7))
        ones = F.call_function("shiftleft", F.lit(1), high - low + 1) - 1
        return F.struct(byte.alias("byte"), F.call_function("shiftleft", ones, F.when(F.col("is_motorola"), 7 - high).otherwise(low)).alias("mask"))

    return F.filter(F.transform(held, mask), lambda b: b["byte"] < _BYTES)


def overlaps(signals: DataFrame) -> DataFrame:
    """Pairs of signals of a message that share a bit and can be in one frame: db, is_extended, can_id, message, i, j, first, second.

    Signals meet in one join, only in bytes that both have bits in. Those of a page
    wait in its slot for others of the page, and once more in the slot of signals of
    no page, which look there only. Rows of bytes are many times the table that they
    come from, by whose size Spark would send them to all tasks: they are shuffled.
    """
    key = ["db", "is_extended", "can_id"]
    page = F.when(F.col("mux_kind") == "m", F.col("mux_page"))
    slots = F.when(F.col("page").isNull(), F.array(F.lit(_NO_PAGE))).otherwise(F.array(F.col("page").cast("long"), F.lit(_NO_PAGE)))
    rows = signals.select(*key, "message", F.col("sig_ix").alias("i"), F.col("signal").alias("first"), page.alias("page"), F.inline(_bytes()))
    one = rows.withColumn("slot", F.coalesce(F.col("page").cast("long"), F.lit(_NO_PAGE)))
    two = rows.select(*key, "byte", F.explode(slots).alias("slot"), F.col("i").alias("j"), F.col("first").alias("second"), F.col("page").alias("p2"), F.col("mask").alias("m2"))
    # a signal of no page meets those of pages from its side only, any others meet from both
    once = (F.col("page").isNull() & F.col("p2").isNotNull()) | (F.col("i") < F.col("j"))
    met = one.join(two.hint("merge"), [*key, "byte", "slot"]).where((F.col("mask").bitwiseAND(F.col("m2")) != 0) & once)
    ahead = F.col("i") < F.col("j")
    pair = lambda a, b, name: F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(name)
    met = met.select(*key, "message", pair("i", "j", "i"), pair("j", "i", "j"), pair("first", "second", "first"), pair("second", "first", "second"))
    return met.dropDuplicates([*key, "i", "j"])


def check_layout(signals: DataFrame) -> DataFrame:
    """Problems of a table of signals: kind, message, first, second, required, dlc, text and the order columns.

    Texts are fixed values of the check command's output. 'past_dlc' is a signal that needs more bytes than its message declares,
    'overlap' two signals of a message that share a bit and can be in one frame:
    signals of different pages can't.
    """
    key = ["db", "is_extended", "can_id"]
    past = signals.where("required > dlc").select(
        *key, F.lit(0).alias("rank"), F.col("sig_ix").alias("i"), F.lit(-1).alias("j"), F.lit("past_dlc").alias("kind"), "message",
        F.col("signal").alias("first"), F.lit(None).cast("string").alias("second"), "required", "dlc",
        F.concat(F.col("message"), F.lit(": signal `"), F.col("signal"), F.lit("` needs "), F.col("required").cast("string"), F.lit(" byte(s) but the message declares "), F.col("dlc").cast("string")).alias("text"),
    )
    overlap = overlaps(signals).select(
        *key, F.lit(1).alias("rank"), "i", "j", F.lit("overlap").alias("kind"), "message", "first", "second",
        F.lit(None).cast("int").alias("required"), F.lit(None).cast("int").alias("dlc"),
        F.concat(F.col("message"), F.lit(": signals `"), F.col("first"), F.lit("` and `"), F.col("second"), F.lit("` overlap")).alias("text"),
    )
    return past.unionByName(overlap)


def check(spark, catalog: Catalog) -> DataFrame:
    """:func:`check_layout` of one database, by identifier, standard ones first, within a message past_dlc
    first and then in the order of the signals."""
    return check_layout(catalog.signals(spark)).orderBy("db", "is_extended", "can_id", "rank", "i", "j")
