"""Commands: decode, check, export and live.

Exit codes: 0 for nothing to report, 1 where something was found or left out, 2
where a command could not run.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame

from buswright.operators.check import check
from buswright.operators.decode import tally
from buswright.operators.resample import ExportError, sample
from buswright.session import scratch, session
from buswright.sinks.ld import Metadata, write_ld
from buswright.sinks.text import HEADER, csv_rows, in_order, tally_text, text_rows
from buswright.sources.candump import read_log
from buswright.sources.dbc import Catalog, DbcError, parse
from buswright.streaming.piped import read_pipe

FOUND, COULD_NOT_RUN = 1, 2


class CouldNotRun(Exception):
    pass


def load_catalog(path: str) -> Catalog:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return parse(f.read())
    except (OSError, UnicodeDecodeError) as e:
        raise CouldNotRun(f"cannot read {path}: {e}") from e
    except DbcError as e:
        raise CouldNotRun(f"{path}: {e}") from e


def seconds(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not (math.isfinite(value) and value > 0):
        raise argparse.ArgumentTypeError("expected a positive number of seconds")
    return value


def rate(text: str) -> int:
    if not text.isdigit() or int(text) > 0xFFFF:
        raise argparse.ArgumentTypeError("expected a rate from 0 to 65535")
    return int(text)


def say(text: str) -> None:
    print(f"buswright: {text}", file=sys.stderr)


def show(rows: Iterable[str]) -> None:
    for row in rows:
        print(row)


def _rows(frames, catalog: Catalog, form: str):
    return csv_rows(frames, catalog) if form == "csv" else text_rows(frames, catalog)


def decode(args: argparse.Namespace) -> int:
    catalog, spark, total = load_catalog(args.dbc), session(), [0, 0, 0, 0]
    if args.log != "-" and not os.path.exists(args.log):
        raise CouldNotRun(f"cannot read {args.log}: no such file")
    if args.format == "csv":
        print(HEADER)

    def each(frames: DataFrame, errors: DataFrame) -> None:
        frames = frames.persist()
        for row in errors.orderBy("seq").toLocalIterator():
            total[3] += 1
            say(row.message)
        show(in_order(_rows(frames, catalog, args.format)))
        sys.stdout.flush()
        about = tally(frames, catalog).first()
        for i, n in enumerate((about.frames, about.unknown, about.unfit)):
            total[i] += n
        frames.unpersist()

    if args.log == "-":
        read_pipe(spark, sys.stdin.buffer, each)
    else:
        each(*read_log(spark, args.log))
    say(tally_text(*total))
    return FOUND if total[3] else 0


def check_command(args: argparse.Namespace) -> int:
    catalog = load_catalog(args.dbc)
    problems = [r.text for r in check(session(), catalog).collect()]
    show(problems)
    # fixed values, as in text.tally_text
    print(f"{args.dbc}: {len(catalog)} message(s), {catalog.signal_count} signal(s), {len(problems)} problem(s)")
    return FOUND if problems else 0


def export(args: argparse.Namespace) -> int:
    catalog = load_catalog(args.dbc)
    if not os.path.exists(args.log):
        raise CouldNotRun(f"cannot read {args.log}: no such file")
    frames, errors = read_log(session(), args.log)
    broken = errors.where("line_no IS NULL").orderBy("seq").first()
    if broken is not None:
        raise CouldNotRun(f"{args.log}: {broken.message}")
    bad = errors.count()
    try:
        sampled = sample(frames.persist(), catalog, args.rate)
    except ExportError as e:
        raise CouldNotRun(str(e)) from e
    try:
        with open(args.output, "wb") as out:
            write_ld(sampled, out, Metadata(args.driver or "", args.vehicle or "", args.venue or "", args.event or ""))
    except OSError as e:
        raise CouldNotRun(f"cannot write {args.output}: {e}") from e
    say(f"{args.output} — {len(sampled.channels)} channels at {sampled.rate} Hz, {sampled.points} samples each, from {sampled.frames} frames")
    if sampled.skipped:
        say(f"{sampled.skipped} signal value(s) dropped: a frame was too short to carry them")
    if bad:
        say(f"{bad} log line(s) could not be read")
    return FOUND if sampled.skipped or bad else 0


def live(args: argparse.Namespace) -> int:
    from buswright.sources.socketcan import SocketCan
    from buswright.streaming.live import run_stream, until_quiet

    catalog, spark = load_catalog(args.dbc), session()
    spark.dataSource.register(SocketCan)
    # all that arrives is in a log before it is shown, so a batch that is lost is read again
    frames = spark.readStream.format("socketcan").option("interface", args.interface).option("log", scratch(spark, "live-frames")).load()
    if args.format == "csv":
        print(HEADER, flush=True)

    def batch(rows) -> None:
        show(in_order(_rows(rows, catalog, args.format)))
        sys.stdout.flush()

    query, counts = run_stream(frames, catalog, batch, scratch(spark, "live-checkpoint"))
    try:
        until_quiet(query, counts, args.timeout)
    except Exception as e:
        say(tally_text(counts.frames, counts.unknown, counts.unfit, 0))
        raise CouldNotRun(f"{args.interface}: {e}") from e
    say(tally_text(counts.frames, counts.unknown, counts.unfit, 0))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="buswright", description="Decode vehicle bus logs with a DBC database.")
    commands = top.add_subparsers(required=True)
    for name, run, words in (("decode", decode, ("dbc", "log")), ("check", check_command, ("dbc",)), ("export", export, ("dbc", "log")), ("live", live, ("dbc", "interface"))):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for word in words:
            p.add_argument(word)
        if name in ("decode", "live"):
            p.add_argument("--format", choices=("text", "csv"), default="text")
        if name == "export":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("--rate", type=rate)
            for word in ("driver", "vehicle", "venue", "event"):
                p.add_argument(f"--{word}")
        if name == "live":
            p.add_argument("--timeout", type=seconds)
    return top


def main(words: list[str] | None = None) -> int:
    args = parser().parse_args(words)
    try:
        return args.run(args)
    except BrokenPipeError:
        # whoever read the output has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except CouldNotRun as e:
        say(str(e))
        return COULD_NOT_RUN


if __name__ == "__main__":
    sys.exit(main())
