"""Decoding streams of frames.

Decoding is a projection and a join with a constant table, so batch and stream
share one function and no state or watermark is needed. Rows come out per
micro-batch, so output is as late as a trigger.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buswright.operators.decode import decode_frames, tally
from buswright.sources.dbc import Catalog


class Stopped(Exception):
    """A batch that begins once its session is over; it isn't committed."""


@dataclass
class Counts:
    """What has been decoded so far; ``arrived`` counts all frames.

    ``last_arrival`` is when the last batch was done, on a monotonic clock, and None
    before the first trigger: the time that a batch takes is no silence.
    """

    arrived: int = 0
    frames: int = 0
    unknown: int = 0
    unfit: int = 0
    last_arrival: float | None = None
    stopping: bool = False
    between_batches: threading.Lock = field(default_factory=threading.Lock)


def decode_stream(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Decoded signals of a stream of frames, in append mode."""
    return decode_frames(frames, catalog)


def run_stream(frames: DataFrame, catalog: Catalog, show: Callable[[DataFrame], None], checkpoint: str | None = None, trigger: dict | None = None) -> tuple[StreamingQuery, Counts]:
    """Start a query that gives ``show`` the frames of each batch and counts what they held.

    Frames without a number get one that is in the order of the batch's rows. A
    batch that is run again after a failure is shown again and counted once. A
    batch without frames is an arrival too: sources have one where only remote or
    error frames came.
    """
    counts, seen = Counts(), set()

    def batch(rows: DataFrame, number: int) -> None:
        with counts.between_batches:
            if counts.stopping:
                raise Stopped
            rows = rows.withColumn("seq", F.coalesce(F.col("seq"), F.monotonically_increasing_id() + 1)).persist()
            try:
                about = tally(rows, catalog).first()
                if number not in seen:
                    seen.add(number)
                    counts.frames += about.frames
                    counts.unknown += about.unknown
                    counts.unfit += about.unfit
                    counts.arrived += about.frames + about.unknown
                if about.frames + about.unknown:
                    show(rows)
            finally:
                rows.unpersist()
                counts.last_arrival = time.monotonic()

    writer = frames.writeStream.foreachBatch(batch).trigger(**(trigger or {"processingTime": "0 seconds"}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start(), counts


def until_quiet(query: StreamingQuery, counts: Counts, seconds: float | None, poll: float = 0.1) -> None:
    """Return when no frame has arrived for ``seconds`` (None: never), or the query has failed, which is raised.

    Silence is measured from the end of the last batch, or from the first trigger
    where there was none, and only ends a query that a trigger has since found
    nothing new for. A query is stopped between batches, never in one.
    """
    try:
        while seconds is not None and query.isActive:
            # all that has arrived by now is shown when this returns, in whatever time that takes
            query.processAllAvailable()
            with counts.between_batches:
                now = time.monotonic()
                if counts.last_arrival is None:
                    counts.last_arrival = now
                counts.stopping = now - counts.last_arrival > seconds
            if counts.stopping:
                query.stop()
                return
            query.awaitTermination(poll)
        query.awaitTermination()
    except Exception:
        if query.exception() is None:
            raise
    if query.exception() is not None:
        raise query.exception()
