"""Irregular updates onto a fixed grid by sample and hold.

No grid is joined: the grid index from which an update holds is arithmetic on its
timestamp, so updates become runs of grid points, which are as many as the
updates, and only the runs are expanded. A channel's grid is cut into tiles of a
bounded number of points: tasks work on tiles, and what the last update of a tile
says is carried over those after it that have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buswright.operators.decode import decode_frames, small
from buswright.sources.dbc import Catalog

#: Sample rates in Hz that loggers are set to.
RATES = (1, 2, 5, 10, 20, 25, 50, 100, 200, 500, 1000)
MAX_SAMPLE_BYTES = 512 * 1024 * 1024
_SECOND = 1_000_000
#: Grid points of a tile: the most that one array of indexes or one piece of a file holds.
TILE = 1 << 16


class ExportError(ValueError):
    def __init__(self, reason: str):
        super().__init__(f"cannot export: {reason}")


def span(frames: DataFrame) -> DataFrame:
    """One row: first and last timestamp of all frames, both null without frames."""
    return frames.agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def default_rate(frames: DataFrame) -> DataFrame:
    """One row: start_us, end_us, fastest (Hz of the most frequent identifier) and rate, the first of
    :data:`RATES` that isn't slower. Identifiers count by number, whatever their width."""
    return _about(frames).drop("frames")


def _about(frames: DataFrame) -> DataFrame:
    """:func:`default_rate` with the number of frames."""
    per = frames.groupBy("can_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    all_ = per.agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.max("n").alias("n"), F.sum("n").alias("frames"))
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(float(_SECOND))
    ladder = F.array(*[F.lit(r) for r in RATES])
    fastest = F.when(seconds > 0, (F.col("n") - 1) / seconds)
    step = F.coalesce(F.array_min(F.filter(ladder, lambda r: r >= F.col("fastest"))), F.lit(RATES[-1]))
    return all_.withColumn("fastest", fastest).select("start_us", "end_us", "fastest", F.when(F.col("fastest").isNull(), F.lit(RATES[0])).otherwise(step).cast("int").alias("rate"), "frames")


def grid_points(start_us: int, end_us: int, rate: int) -> int:
    return (end_us - start_us) * rate // _SECOND + 1


def runs(updates: DataFrame, keys: list[str], first_index: Column, points: Column | int, value: str = "value", order: tuple[str, ...] = ("ts_us", "seq")) -> DataFrame:
    """keys, tile, lo, hi and value: grid points lo to hi of a channel hold the value.

    ``first_index`` is the first grid index at or after an update. A point takes
    the last update up to it; points before a channel's first update take that
    update. Equal timestamps go by the log's order. Runs cover points 0 to
    ``points`` - 1 of each channel once, and none leaves its tile of :data:`TILE`
    points, so any grid is expanded in bounded steps and by many tasks.

    Updates are reduced to one per grid point before they meet, then sorted within
    a tile. Tiles are shuffled once: the runs within them and the values that they
    carry on are made from the same exchange.
    """
    spark = updates.sparkSession
    many = not isinstance(points, int) or points > TILE
    points = F.lit(points) if isinstance(points, int) else points
    at = F.struct(*[F.col(c) for c in order], F.col(value).alias("v"))
    # all points before the first have one update that matters, and all past the end none but the first
    k = F.greatest(F.least(first_index, points), F.lit(0)).cast("long")
    steps = updates.withColumn("__k", k).groupBy(*keys, "__k").agg(F.max(at).alias("__last"), F.min(at).alias("__first"))
    tile_of = lambda k: F.call_function("div", k, F.lit(TILE))
    # a number of tasks of its own: few updates can have very many points
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.withColumn("tile", tile_of(F.col("__k"))).repartition(spread, *keys, "tile")
    begins, ends = F.col("tile") * TILE, F.least((F.col("tile") + 1) * TILE, points) - 1

    inside = Window.partitionBy(*keys, "tile").orderBy("__k")
    stop = F.least(F.coalesce(F.lead("__k").over(inside) - 1, ends), points - 1)
    # both halves name all columns of the exchange, so that they share it
    own = steps.where("__first IS NOT NULL").select(*keys, "tile", F.col("__k").alias("lo"), stop.alias("hi"), F.col("__last.v").alias(value))

    # a row a tile that has updates
    tiles = steps.groupBy(*keys, "tile").agg(F.min("__k").alias("__k"), F.min("__first").alias("__first"), F.max(F.struct("__k", "__last")).alias("__end"))
    channel = Window.partitionBy(*keys).orderBy("tile")
    before = F.struct(F.lit(0).cast("long").alias("lo"), (F.col("__k") - 1).alias("hi"), F.col("__first.v").alias("v"))
    after = F.struct((ends + 1).cast("long").alias("lo"), (F.col("__next") - 1).cast("long").alias("hi"), F.col("__end.__last.v").alias("v"))
    tiles = tiles.withColumn("__next", F.coalesce(F.lead("__k").over(channel), points)).withColumn("__begins", F.row_number().over(channel) == 1)
    carried = tiles.select(*keys, F.explode(F.when(F.col("__begins"), F.array(before, after)).otherwise(F.array(after))).alias("__run"))
    carried = carried.where("__run.lo <= __run.hi").withColumn("tile", F.explode(F.sequence(tile_of(F.col("__run.lo")), tile_of(F.col("__run.hi")))))
    if many:
        carried = carried.repartition(spread, *keys, "tile")
    carried = carried.select(*keys, "tile", F.greatest(F.col("__run.lo"), begins).alias("lo"), F.least(F.col("__run.hi"), ends).alias("hi"), F.col("__run.v").alias(value))
    return own.where("lo <= hi").unionByName(carried)


def hold(updates: DataFrame, keys: list[str], first_index: Column, points: Column | int, value: str = "value", order: tuple[str, ...] = ("ts_us", "seq")) -> DataFrame:
    """keys, k and value at grid points 0 to ``points`` - 1 of each channel, the points of :func:`runs`."""
    held = runs(updates, keys, first_index, points, value, order)
    return held.select(*keys, F.explode(F.sequence("lo", "hi")).alias("k"), value)


def index_at_rate(ts_us: Column, start_us: int, rate: int) -> Column:
    """The first k whose grid time start + k * 1e6 div rate is at or after ``ts_us``."""
    past = ts_us - F.lit(start_us)
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    # whole seconds and the rest apart: no product leaves the range of a BIGINT, no quotient goes through a double
    return div(past, _SECOND) * F.lit(rate) + div((past % F.lit(_SECOND)) * F.lit(rate) + F.lit(_SECOND - 1), _SECOND)


@dataclass
class Sampled:
    """A resampled log: runs (channel_ix, tile, lo, hi, sample), channels in order, and what was left out."""

    runs: DataFrame
    channels: list[tuple[int, str, str]]
    start_us: int
    rate: int
    points: int
    frames: int
    skipped: int

    @property
    def samples(self) -> DataFrame:
        """channel_ix, k and sample: a row for each channel and grid point."""
        return self.runs.select("channel_ix", F.explode(F.sequence("lo", "hi")).alias("k"), "sample")


def layout(catalog: Catalog) -> list[tuple[int, int, bool, str, str]]:
    """(channel_ix, can_id, is_extended, signal, unit) of each channel: by number, then width, then the
    database's order. A signal name that comes twice in a message keeps the later place."""
    out, ix = {}, 0
    for m in sorted(catalog, key=lambda m: (m.can_id, m.is_extended)):
        for s in m.signals:
            out[m.can_id, m.is_extended, s.name] = (ix, m.can_id, m.is_extended, s.name, s.unit)
            ix += 1
    return list(out.values())


def sample(frames: DataFrame, catalog: Catalog, rate: int | None = None) -> Sampled:
    """Decode ``frames`` and resample each signal that they carry onto one grid, from the first frame to the last.

    Channels go by identifier and width: a standard and an extended identifier of
    equal number keep channels of their own. Only scalars and the channel list come
    to the driver. Raises ExportError for an empty log, a rate of 0, a log without
    any signal of the catalog and more than 512 MiB of samples, in that order.
    """
    spark = frames.sparkSession
    about = _about(frames).first()
    if about.start_us is None:
        raise ExportError("a log without frames has nothing to sample")
    if rate == 0:
        raise ExportError("0 Hz is not a rate to sample at")
    rate = about.rate if rate is None else rate
    points = grid_points(about.start_us, about.end_us, rate)

    decoded = decode_frames(frames, catalog)
    places = layout(catalog)
    slots = spark.createDataFrame([p[:4] for p in places], "channel_ix INT, can_id BIGINT, is_extended BOOLEAN, signal STRING")
    updates = decoded.join(small(slots, len(places)), ["can_id", "is_extended", "signal"])
    # one row a channel: values that fit and values that don't
    found = updates.groupBy("channel_ix").agg(F.count_if(F.col("status") == "ok").alias("n"), F.count_if(F.col("status") == "unfit").alias("unfit")).collect()
    carried, skipped = {r.channel_ix: r.n for r in found}, sum(r.unfit for r in found)
    channels = [(ix, name, unit) for ix, _, _, name, unit in places if carried.get(ix)]
    if not channels:
        raise ExportError("the log carries none of the database's signals")
    size = len(channels) * points * 4
    if size > MAX_SAMPLE_BYTES:
        raise ExportError(f"sampling {len(channels)} channels at {rate} Hz takes {size} bytes, more than {MAX_SAMPLE_BYTES}; a lower rate takes less")
    values = updates.where("status = 'ok'").select("channel_ix", "ts_us", "seq", F.col("value").cast("float").alias("sample"))
    held = runs(values, ["channel_ix"], index_at_rate(F.col("ts_us"), about.start_us, rate), points, "sample")
    return Sampled(held, channels, about.start_us, rate, points, about.frames, skipped)
