"""A catalog compiled into expressions.

Where a log is decoded for one known database the layouts can be literals: shift
counts fold away and no join is left. :func:`wide` makes each signal a column of its
message's frames, :func:`long` rows. There only the bits of each signal are
compiled; what turns them into values are constant arrays by the signal's number,
so the generated code stays small enough to be compiled by the JVM, whatever the
number of signals of a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.functions.bits import extract_raw, little_word, mask, word
from buswright.functions.values import scale, unsigned_double
from buswright.sources.dbc import Catalog, Message, Signal

#: The first eight bytes of a payload as one word of either byte order; most layouts lie in them.
_LITTLE, _BIG, _SIZE = "little", "big", "size"


def _words(frames: DataFrame) -> DataFrame:
    digits = F.rpad(F.hex(F.substring("payload", 1, 8)), 16, "0")
    return frames.select("seq", "ts_us", "can_id", "is_extended", "payload", little_word(digits).alias(_LITTLE), word(digits).alias(_BIG), F.length("payload").alias(_SIZE))


def _plain(s: Signal) -> Column:
    """A signal's bits where its payload is long enough: a shift and a mask, if it lies in the first eight bytes."""
    first = s.start_bit // 8 * 8 + 7 - s.start_bit % 8 if s.is_motorola else s.start_bit
    if first + s.length > 64:
        return extract_raw(F.col("payload"), s.start_bit, s.length, s.is_motorola, F.lit(True))
    down = 64 - first - s.length if s.is_motorola else first
    bits = F.shiftrightunsigned(_BIG if s.is_motorola else _LITTLE, down)
    return bits if s.length == 64 else bits.bitwiseAND(mask(s.length))


def _raw(s: Signal, message: Message) -> Column:
    fits, mux = F.col(_SIZE) >= s.required, message.multiplexor
    if s.mux_kind == "m" and mux is not None:
        fits = fits & (F.col(_SIZE) >= mux.required) & (_plain(mux) == s.mux_page)
    return F.when(fits, _plain(s))


def _is(message: Message) -> Column:
    return (F.col("can_id") == message.can_id) & (F.col("is_extended") == message.is_extended)


def wide(frames: DataFrame, message: Message) -> DataFrame:
    """The frames of one message with a column of physical values for each signal, null where it isn't carried."""
    own = _words(frames.where(_is(message)))
    values = [scale(_raw(s, message), s.length, s.is_signed, s.factor, s.offset).alias(s.name) for s in message.signals]
    return own.select("seq", "ts_us", *values)


def long(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """The decoded signals of all messages: seq, ts_us, can_id, is_extended, message, sig_ix, signal, raw, value, unit, label.

    Signals that don't fit have no row here; the data-driven plan reports them. One
    pass over the frames: each makes an array of its own message's signals' bits.
    """
    signals, raws, first = [], None, None
    for m in catalog:
        if not m.signals:
            continue
        bits, base = F.array(*[_raw(s, m) for s in m.signals]), F.lit(len(signals))
        raws, first = (F.when(_is(m), bits), F.when(_is(m), base)) if raws is None else (raws.when(_is(m), bits), first.when(_is(m), base))
        signals += [(m, i, s) for i, s in enumerate(m.signals)]
    keys = ["seq", "ts_us", "can_id", "is_extended"]
    if raws is None:
        none = {"message": "string", "sig_ix": "int", "signal": "string", "raw": "long", "value": "double", "unit": "string", "label": "string"}
        return frames.limit(0).select(*keys, *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])

    def of(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("at"))

    at = _words(frames).select(*keys, first.alias("first"), F.posexplode(raws).alias("i", "raw")).where("raw IS NOT NULL")
    at = at.select(*keys, "raw", (F.col("first") + F.col("i")).alias("at"), F.col("i").alias("sig_ix"))
    gap = of([64 - s.length if s.is_signed else 0 for *_, s in signals])
    at = at.withColumn("number", F.call_function("shiftright", F.call_function("shiftleft", F.col("raw"), gap), gap))
    wide_ones = any(s.length == 64 and not s.is_signed for *_, s in signals)
    unsigned = of([not s.is_signed for *_, s in signals])
    double = F.when(unsigned, unsigned_double(F.col("raw"))).otherwise(F.col("number").cast("double")) if wide_ones else F.col("number").cast("double")
    value = double * of([s.factor for *_, s in signals]) + of([s.offset for *_, s in signals])
    label = F.lit(None).cast("string")
    if any(s.labels for *_, s in signals):
        none = F.lit(None).cast("map<bigint,string>")
        tables = [F.create_map(*[x for k, v in s.labels.items() for x in (F.lit(k).cast("long"), F.lit(v))]) if s.labels else none for *_, s in signals]
        table = F.get(F.array(*tables), F.col("at"))
        # patterns of 2**63 and up have no label without a sign
        key = F.when(~unsigned | (F.col("raw") >= 0), F.col("number")) if wide_ones else F.col("number")
        label = F.when(table.isNotNull() & key.isNotNull(), F.try_element_at(table, key))
    return at.select(
        *keys, of([m.name for m, *_ in signals]).alias("message"), "sig_ix", of([s.name for *_, s in signals]).alias("signal"), "raw",
        value.alias("value"), of([s.unit for *_, s in signals]).alias("unit"), label.alias("label"),
    )
