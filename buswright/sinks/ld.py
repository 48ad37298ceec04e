"""The motorsport log format .ld, written from resampled channels.

A file is a header, an event block, a header for each channel and then each
channel's samples as 32-bit floats. Tasks pack tiles of a channel, straight from
the runs that resampling gives, to pieces whose place in the file is known; the
driver writes the headers and then the pieces as they come in order.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.operators.resample import Sampled

# Fixed values of the format: sizes of the blocks, and offsets and values of their fields.
HEADER_BYTES, EVENT_BYTES, CHANNEL_BYTES = 1762, 1154, 124
_HEADER = ((0, "<I", 0x40), (36, "<I", HEADER_BYTES), (64, "<H", 1), (66, "<H", 0x4240), (68, "<H", 0x000F), (70, "<I", 0x1F44), (74, "8s", b"ADL"), (82, "<H", 420), (84, "<H", 0xADB0), (1502, "<I", 0x000C81A4))
_FIRST_COUNTER, _FLOAT_CLASS, _FLOAT_BYTES = 0x2EE1, 7, 4
NAME, SHORT_NAME, UNIT, TEXT = 32, 8, 12, 64


@dataclass
class Metadata:
    driver: str = ""
    vehicle: str = ""
    venue: str = ""
    event: str = ""


def ascii_field(text: str, limit: int) -> str:
    """The printable ASCII of a text, cut to ``limit`` and then trimmed."""
    return "".join(c for c in text if " " <= c <= "~")[:limit].strip()


def channel_names(channels: list[tuple[int, str, str]]) -> list[tuple[int, str, str, str]]:
    """(channel_ix, name, short name, unit) with names that are told apart by _2, _3 and so on."""
    taken: set[str] = set()
    out = []
    for ix, name, unit in channels:
        base = own = ascii_field(name, NAME)
        n = 1
        while own in taken:
            n += 1
            suffix = f"_{n}"
            own = ascii_field(base, NAME - len(suffix)) + suffix
        taken.add(own)
        out.append((ix, own, ascii_field(own, SHORT_NAME), ascii_field(unit, UNIT)))
    return out


def date_and_time(start_us: int) -> tuple[str, str]:
    at = datetime.fromtimestamp(start_us // 1_000_000, UTC)
    return at.strftime("%d/%m/%Y"), at.strftime("%H:%M:%S")


def date_column(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "dd/MM/yyyy")


def time_column(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "HH:mm:ss")


def _put(block: bytearray, at: int, layout: str, value: int | bytes | str) -> None:
    struct.pack_into(layout, block, at, value.encode() if isinstance(value, str) else value)


def headers(names: list[tuple[int, str, str, str]], start_us: int, rate: int, points: int, about: Metadata) -> bytes:
    """All of a file but its samples."""
    first_channel = HEADER_BYTES + EVENT_BYTES
    data = first_channel + CHANNEL_BYTES * len(names)
    date, time = date_and_time(start_us)
    head = bytearray(HEADER_BYTES)
    own = ((8, "<I", first_channel), (12, "<I", data), (86, "<I", len(names)), (94, "16s", date), (126, "16s", time), (158, "64s", about.driver), (222, "64s", about.vehicle), (350, "64s", about.venue), (1572, "64s", about.event))
    for at, layout, value in (*_HEADER, *own):
        _put(head, at, layout, value)
    event = bytearray(EVENT_BYTES)
    _put(event, 0, "64s", about.event)
    _put(event, 64, "64s", "1")
    out = [bytes(head), bytes(event)]
    for i, (_, name, short, unit) in enumerate(names):
        at, block = first_channel + i * CHANNEL_BYTES, bytearray(CHANNEL_BYTES)
        neighbours = (at - CHANNEL_BYTES if i else 0, at + CHANNEL_BYTES if i + 1 < len(names) else 0)
        struct.pack_into("<IIIIHHHHhhhh", block, 0, *neighbours, data + i * points * _FLOAT_BYTES, points, (_FIRST_COUNTER + i) & 0xFFFF, _FLOAT_CLASS, _FLOAT_BYTES, rate, 0, 1, 1, 0)
        for place, layout, value in ((32, "32s", name), (64, "8s", short), (72, "12s", unit)):
            _put(block, place, layout, value)
        out.append(bytes(block))
    return b"".join(out)


def packed_tiles(runs: DataFrame) -> DataFrame:
    """channel_ix, tile, first (its first point), points and body, the samples of the tile as bytes: a quarter of a megabyte at the most."""

    def pack(rows: pa.Table) -> pa.Table:
        lo, hi, sample = (rows[c].to_numpy() for c in ("lo", "hi", "sample"))
        order = np.argsort(lo)
        lo, hi, sample = lo[order], hi[order], sample[order]
        if (lo[1:] != hi[:-1] + 1).any():
            raise ValueError("the runs of a tile leave points out or overlap")
        body = np.repeat(sample.astype("<f4"), hi - lo + 1).tobytes()
        one = {"channel_ix": rows["channel_ix"][:1], "tile": rows["tile"][:1], "first": [int(lo[0])], "points": [int(hi[-1] - lo[0] + 1)], "body": [body]}
        return pa.table(one, schema=pa.schema([("channel_ix", pa.int32()), ("tile", pa.int64()), ("first", pa.int64()), ("points", pa.int64()), ("body", pa.binary())]))

    held = runs.select(F.col("channel_ix").cast("int").alias("channel_ix"), F.col("tile").cast("long").alias("tile"), "lo", "hi", F.col("sample").cast("float").alias("sample"))
    return held.groupBy("channel_ix", "tile").applyInArrow(pack, "channel_ix int, tile long, first long, points long, body binary")


def write_ld(sampled: Sampled, out: BinaryIO, about: Metadata | None = None) -> int:
    """Write a file and return its number of bytes. A piece that isn't where the last one ended is an error."""
    names = channel_names(sampled.channels)
    size = out.write(headers(names, sampled.start_us, sampled.rate, sampled.points, about or Metadata()))
    pieces = packed_tiles(sampled.runs).orderBy("channel_ix", "tile").toLocalIterator(prefetchPartitions=True)
    at = [(ix, name) for ix, name, _, _ in names]
    done, place = 0, 0
    for row in pieces:
        if place == sampled.points:
            done, place = done + 1, 0
        if done == len(at) or (row.channel_ix, row.first) != (at[done][0], place):
            raise ValueError(f"cannot export: channel `{at[min(done, len(at) - 1)][1]}` carries {place} samples but the session has {sampled.points}")
        size, place = size + out.write(bytes(row.body)), place + row.points
    if (done, place) != (len(at) - 1, sampled.points):
        raise ValueError(f"cannot export: channel `{at[done][1]}` carries {place} samples but the session has {sampled.points}")
    return size


def read_samples(content: bytes) -> dict[str, np.ndarray]:
    """The channels of a file by name, to check one that was written."""
    at, out = struct.unpack_from("<I", content, 8)[0], {}
    while at:
        _, following, data, count = struct.unpack_from("<IIII", content, at)
        name = content[at + 32 : at + 64].rstrip(b"\0").decode()
        out[name] = np.frombuffer(content, "<f4", count, data)
        at = following
    return out
