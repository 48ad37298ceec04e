"""Logs made from counters: any length, by any number of tasks, equal on every run.

A frame is a function of a seed and its number alone, so no task needs what
another made and a lost one is made again. Signals are waves between 0 and their
largest raw value (24 bits at the most), each with a pace and a phase of its own.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.functions.bits import bound, insert_raw
from buswright.sources.dbc import Catalog, Message, Signal


def sent(catalog: Catalog) -> list[Message]:
    """The messages that take turns in a log: those with signals, by identifier."""
    return [m for m in catalog if m.signals]


def wave(message: str, signal: str, length: int) -> tuple[int, int, int, int]:
    """(top, per_seed, per_turn, phase): at a turn a signal is ``abs((seed * per_seed + turn * per_turn + phase) % (2 * top) - top)``."""
    h = zlib.crc32(f"{message}.{signal}".encode())
    return (1 << min(length, 24)) - 1, 1 + h % 97, 1 + (h >> 8) % 31, h % 1000


def pages(message: Message) -> list[int]:
    """The pages that a message shows in turn; its multiplexor's value is the page."""
    return sorted({s.mux_page for s in message.signals if s.mux_kind == "m"})


def raw_value(message: Message, signal: Signal, seed: Column, turn: Column) -> Column:
    shown = pages(message)
    if signal.mux_kind == "M" and shown:
        return F.get(F.array(*[F.lit(p).cast("long") for p in shown]), F.pmod(seed + turn, F.lit(len(shown))).cast("int"))
    top, a, b, c = wave(message.name, signal.name, signal.length)
    return F.abs(F.pmod(seed * a + turn * b + c, F.lit(2 * top)) - top)


def _on_page(message: Message, signal: Signal, seed: Column, turn: Column, then: Column, other: Column) -> Column:
    shown = pages(message)
    if signal.mux_kind != "m" or message.multiplexor is None:
        return then
    return F.when(F.pmod(seed + turn, F.lit(len(shown))) == shown.index(signal.mux_page), then).otherwise(other)


def _swapped_bytes(word: Column) -> Column:
    step = lambda x, bits, mask: F.shiftleft(x.bitwiseAND(F.lit(mask)), bits).bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)))
    return bound(bound(word, lambda x: step(x, 8, 0x00FF00FF00FF00FF)), lambda x: bound(step(x, 16, 0x0000FFFF0000FFFF), lambda y: F.shiftleft(y, 32).bitwiseOR(F.shiftrightunsigned(y, 32))))


def _word_payload(message: Message, seed: Column, turn: Column) -> Column:
    """A payload of up to eight bytes: a word in each byte order, made by shifts, and their bytes put together."""
    words = {False: F.lit(0).cast("long"), True: F.lit(0).cast("long")}
    for s in message.signals:
        first = s.start_bit // 8 * 8 + 7 - s.start_bit % 8
        put = F.shiftleft(raw_value(message, s, seed, turn), 64 - first - s.length if s.is_motorola else s.start_bit)
        words[s.is_motorola] = words[s.is_motorola].bitwiseOR(_on_page(message, s, seed, turn, put, F.lit(0).cast("long")))
    digits = F.lpad(F.hex(words[True].bitwiseOR(_swapped_bytes(words[False]))), 16, "0")
    return F.unhex(F.substring(digits, 1, 2 * message.dlc))


def _payload(message: Message, seed: Column, turn: Column) -> Column:
    if message.dlc <= 8 and all(s.required <= message.dlc for s in message.signals):
        return _word_payload(message, seed, turn)

    def put(payload: Column, left: list[Signal]) -> Column:
        if not left:
            return payload
        signal, *rest = left
        filled = insert_raw(payload, signal.start_bit, signal.length, signal.is_motorola, raw_value(message, signal, seed, turn))
        return bound(_on_page(message, signal, seed, turn, filled, payload), lambda p: put(p, rest))

    return bound(F.lit(bytes(message.dlc)), lambda p: put(p, list(message.signals)))


def generate(counters: DataFrame, catalog: Catalog, start_us: int = 0, step_us: int = 1000) -> DataFrame:
    """A frame for each of ``counters`` (seed, n), with ``seed`` and the columns of frames.

    Frame n of a seed comes ``n * step_us`` after the start and is of the catalog's
    messages the one whose turn it is. ``spark.range(k).selectExpr("7L AS seed",
    "id AS n")`` makes a log of k frames.
    """
    messages = sent(catalog)
    if not messages:
        raise ValueError("a catalog without signals has nothing to send")
    seed, n = F.col("seed").cast("long"), F.col("n").cast("long")
    turn, which = F.call_function("div", n, F.lit(len(messages))), F.pmod(n, F.lit(len(messages)))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), which.cast("int"))
    payload = None
    for i, m in enumerate(messages):
        payload = F.when(which == i, _payload(m, seed, turn)) if payload is None else payload.when(which == i, _payload(m, seed, turn))
    out = counters.select(seed.alias("seed"), n.alias("seq"), n.alias("line_no"), (F.lit(start_us) + n * step_us).alias("ts_us"), of([m.can_id for m in messages]).cast("long").alias("can_id"), of([m.is_extended for m in messages]).alias("is_extended"), payload.alias("payload"))
    return out.withColumn("len", F.length("payload")).withColumn("len8_dlc", F.lit(None).cast("int"))
