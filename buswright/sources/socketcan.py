"""Frames from a SocketCAN interface, as a stream source named ``socketcan``.

A bus has one receiver and can't be read twice, so the driver's reader, on the host
that the interface belongs to, writes what it receives to a log of segments in a
folder that all executors share, and offsets are numbers of segments. A thread
receives all the time, however long a batch takes. Tasks read segments from the
folder, a partition each: a batch that is lost is read again, and a query that is
started again from its checkpoint goes on where it stopped.

Options: ``interface`` (``can0``, or ``unix:<path>`` for a socket to which a gateway
sends frames as datagrams), ``log`` (the folder, of one query alone), ``idle``
(seconds to wait for frames in one trigger, 0.2) and ``keep`` (``true``: segments
stay as a recording after Spark has done with them). Frames carry the kernel's
receive time, the clock that logs have.
"""

from __future__ import annotations

import os
import socket
import struct
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from buswright.schemas import FRAMES

# Fixed values of the kernel's interface.
_CLASSIC, _FD = 16, 72
_EXTENDED, _REMOTE, _ERROR = 0x80000000, 0x40000000, 0x20000000
_RAW_FD_FRAMES, _SOL_CAN_RAW, _TIMESTAMP_NS = 5, 101, 35
#: Frames of a segment at the most, so that a task reads a bounded number.
SEGMENT = 10_000

_COLUMNS = pa.schema([("seq", pa.int64()), ("line_no", pa.int64()), ("ts_us", pa.int64()), ("can_id", pa.int64()), ("is_extended", pa.bool_()), ("payload", pa.binary()), ("len", pa.int32()), ("len8_dlc", pa.int32())])


def unpack(data: bytes, at_us: int) -> tuple | None:
    """(ts_us, can_id, is_extended, payload) of a received frame; None for remote and error frames."""
    if len(data) not in (_CLASSIC, _FD):
        raise ValueError(f"a frame of {len(data)} bytes")
    raw, size = struct.unpack_from("=IB", data)
    if raw & _ERROR or (raw & _REMOTE and len(data) == _CLASSIC):
        return None
    extended = bool(raw & _EXTENDED)
    return max(at_us, 0), raw & (0x1FFFFFFF if extended else 0x7FF), extended, data[8 : 8 + size]


class FrameLog:
    """Segments of frames in a folder: files named by their number, their first frame's and how many they hold."""

    def __init__(self, folder: str):
        scheme = folder.split(":", 1)[0] if "://" in folder or folder.startswith("file:") else ""
        self.fs, self.path = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if scheme in ("", "file") else fs.FileSystem.from_uri(folder)

    def segments(self) -> dict[int, tuple[int, int, str]]:
        """By number: first frame, frames, path."""
        out = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            name, ending = os.path.splitext(info.base_name)
            if ending == ".frames":
                number, first, count = map(int, name.split("-"))
                out[number] = (first, count, info.path)
        return out

    def append(self, number: int, first: int, rows: list[tuple]) -> None:
        """A segment appears whole or not at all."""
        self.fs.create_dir(self.path, recursive=True)
        columns = zip(*((first + i, None, ts, can_id, extended, payload, len(payload), None) for i, (ts, can_id, extended, payload) in enumerate(rows)), strict=True)
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _COLUMNS, strict=True)], schema=_COLUMNS)
        final = f"{self.path}/{number:012d}-{first:015d}-{len(rows)}.frames"
        with self.fs.open_output_stream(f"{final}.part") as out, pa.ipc.new_stream(out, _COLUMNS) as writer:
            writer.write_table(table)
        self.fs.move(f"{final}.part", final)

    def read(self, path: str) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
            yield from reader

    def drop(self, last: int) -> None:
        for number, (_, _, path) in self.segments().items():
            if number <= last:
                self.fs.delete_file(path)


@dataclass
class Segment(InputPartition):
    path: str


def _bound(interface: str) -> socket.socket:
    if interface.startswith("unix:"):
        s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
        s.bind(interface.removeprefix("unix:"))
        return s
    s = socket.socket(socket.PF_CAN, socket.SOCK_RAW, socket.CAN_RAW)
    s.setsockopt(_SOL_CAN_RAW, _RAW_FD_FRAMES, 1)
    s.setsockopt(socket.SOL_SOCKET, _TIMESTAMP_NS, 1)
    s.bind((interface,))
    return s


class Receiver:
    """Receives on a thread. ``arrived`` counts all frames, also remote and error frames, which are not kept."""

    def __init__(self, s: socket.socket):
        self.socket, self.rows, self.arrived, self.failed = s, [], 0, None
        self.changed, self.open = threading.Condition(), True
        s.settimeout(0.2)
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while self.open:
            try:
                data, extra, _, _ = self.socket.recvmsg(_FD, 64)
                stamp = next((struct.unpack("=qq", d) for _, kind, d in extra if kind == _TIMESTAMP_NS), None)
                frame = unpack(data, stamp[0] * 1_000_000 + stamp[1] // 1000 if stamp else time.time_ns() // 1000)
            except TimeoutError:
                continue
            except (OSError, ValueError) as e:
                with self.changed:
                    self.failed = e
                    self.changed.notify()
                return
            with self.changed:
                self.arrived += 1
                if frame is not None:
                    self.rows.append(frame)
                self.changed.notify()

    def taken(self, wait: float) -> tuple[list[tuple], int]:
        """What has been received since, after waiting for a frame. A failure is raised once all that came before it was taken."""
        with self.changed:
            if not self.rows and self.failed is None:
                self.changed.wait(wait)
            rows, self.rows = self.rows, []
            if not rows and self.failed is not None:
                raise self.failed
            return rows, self.arrived

    def close(self) -> None:
        self.open = False
        self.socket.close()


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.interface, self.idle = options["interface"], float(options.get("idle", "0.2"))
        self.keep = str(options.get("keep", "false")).lower() == "true"
        self.folder, self.receiver = options["log"], None

    def initialOffset(self) -> dict:
        return {"segment": 0, "arrived": 0}

    def latestOffset(self) -> dict:
        log = FrameLog(self.folder)
        if self.receiver is None:
            known = log.segments()
            self.last = max(known, default=0)
            self.seq = known[self.last][0] + known[self.last][1] if known else 1
            self.receiver = Receiver(_bound(self.interface))
        rows, arrived = self.receiver.taken(self.idle)
        for at in range(0, len(rows), SEGMENT):
            part = rows[at : at + SEGMENT]
            log.append(self.last + 1, self.seq, part)
            self.last, self.seq = self.last + 1, self.seq + len(part)
        return {"segment": self.last, "arrived": arrived}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        known = FrameLog(self.folder).segments()
        wanted = range(int(start["segment"]) + 1, int(end["segment"]) + 1)
        if lost := [n for n in wanted if n not in known]:
            raise ValueError(f"segment {lost[0]} of {self.folder} is missing")
        return [Segment(known[n][2]) for n in wanted]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return FrameLog(self.folder).read(partition.path)

    def commit(self, end: dict) -> None:
        if not self.keep:
            # the newest stays, since numbers go on from it
            FrameLog(self.folder).drop(int(end["segment"]) - 1)

    def stop(self) -> None:
        if self.receiver is not None:
            self.receiver.close()


class SocketCan(DataSource):
    """``spark.dataSource.register(SocketCan)``, then ``readStream.format("socketcan")``."""

    @classmethod
    def name(cls) -> str:
        return "socketcan"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> _Reader:
        for option in ("interface", "log"):
            if not self.options.get(option):
                raise ValueError(f"socketcan needs the option {option}")
        return _Reader(dict(self.options))
