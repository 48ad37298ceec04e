"""A log that comes through a pipe, read while it comes.

The driver cuts the input at line ends into files of a folder that all executors
share, and a stream reads them: rows come out before the input ends, nothing is
kept on a local disk, and a piece that a lost executor was reading is read again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buswright.session import scratch
from buswright.sources.candump import _lines, frames_and_errors, number

#: Bytes of a piece, about, and the seconds after which a smaller one is written.
PIECE, WAIT = 1 << 20, 0.5


class Spool:
    """Writes a stream of bytes to files named by the numbers of their first line, counted with and without lines that are no text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(folder))
        self.seq, self.line, self.failed = 1, 1, None

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def write(self, piece: bytes) -> None:
        """A file appears whole."""
        name = f"{self.folder}/{self.seq:018d}-{self.line:018d}.log"
        out = self.fs.create(self._path(f"{self.folder}/_{self.seq}"))
        out.write(piece)
        out.close()
        self.fs.rename(self._path(f"{self.folder}/_{self.seq}"), self._path(name))
        lines = piece.split(b"\n")[: -1 if piece.endswith(b"\n") else None]
        self.seq += len(lines)
        self.line += sum(map(_is_text, lines))

    def copy(self, source: BinaryIO) -> None:
        """All of ``source``, a piece at a time."""
        held, since = [], time.monotonic()
        try:
            while more := source.read1(PIECE):
                held.append(more)
                if sum(map(len, held)) < PIECE and time.monotonic() - since < WAIT:
                    continue
                whole, end, rest = b"".join(held).rpartition(b"\n")
                if end:
                    self.write(whole + end)
                    held, since = [rest], time.monotonic()
            if rest := b"".join(held):
                self.write(rest)
        except BaseException as e:
            self.failed = e

    def clear(self) -> None:
        self.fs.delete(self._path(self.folder), True)


def _is_text(line: bytes) -> bool:
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def read_pipe(spark: SparkSession, source: BinaryIO, each: Callable[[DataFrame, DataFrame], None]) -> None:
    """Call ``each`` with the frames and the error rows of each batch of a log, in order, until ``source`` ends.

    Lines are numbered as in a file. What was spooled is deleted at the end.
    """
    spool = Spool(spark, scratch(spark, "piped"))
    part = F.regexp_extract(F.col("path"), r"(\d+)-(\d+)\.log$", 1).cast("long"), F.regexp_extract(F.col("path"), r"(\d+)-(\d+)\.log$", 2).cast("long")

    def batch(lines: DataFrame, _: int) -> None:
        each(*frames_and_errors(number(lines, *part)))

    query = _lines(spark.readStream, spool.folder).writeStream.foreachBatch(batch).option("checkpointLocation", scratch(spark, "piped-checkpoint")).trigger(processingTime="0 seconds").start()
    try:
        copying = threading.Thread(target=spool.copy, args=(source,), daemon=True)
        copying.start()
        while copying.is_alive() and query.isActive:
            copying.join(0.1)
        if query.isActive:
            query.processAllAvailable()
        if query.exception() is not None:
            raise query.exception()
        if spool.failed is not None:
            raise spool.failed
    finally:
        query.stop()
        spool.clear()
