"""Logs byte for byte, over blocks, and through a pipe while they come."""

import io
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from buswright import cli
from buswright.operators import check
from buswright.sources import candump
from buswright.sources.dbc import Catalog, Message, Signal, parse_texts
from buswright.streaming import piped

LAMP = 'BO_ 77 Lamp: 2 N\n SG_ Dim : 0|8@1+ (0.5,0) [0|0] "%" L\n'


def plain(data):
    """(seq, line_no, good) of each line."""
    out, line = [], 0
    for seq, raw in enumerate(data.split(b"\n")[: -1 if data.endswith(b"\n") else None], 1):
        try:
            raw.decode()
            line += 1
            out.append((seq, line, raw.rstrip(b"\r")[:1] == b"("))
        except UnicodeDecodeError:
            out.append((seq, None, False))
    return out


def log_bytes(n, seed):
    r = random.Random(seed)
    kinds = [b"(%d.5) can7 04D#%02X00", b"(%d.5) can7 04D#%02X00\r", b"(%d.25) can7\xff 04D#%02X", b"no frame \xc3\xa9 %d %d", b"\x80%d%d", b"(%d.5)\rcan7\r04D#%02X00"]
    return b"\n".join(r.choice(kinds) % (i, i % 256) for i in range(n)) + b"\n"


@pytest.mark.parametrize("size", ["700", "128m"])
def test_lines_that_are_no_text_are_errors_without_a_number(spark, tmp_path, size):
    data = {f"{n}.log": log_bytes(120, n) for n in range(3)} | {"3.log": b"(1.0) can7 04D#0100\n", "4.log": b"\xfe\n\xfe"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        frames, errors = candump.read_log(spark, str(tmp_path))
        got = sorted([(r.seq, r.line_no, True) for r in frames.collect()] + [(r.seq, r.line_no, False) for r in errors.collect()])
        said = {r.message for r in errors.where("line_no IS NULL").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, before = [], 0
    for name in sorted(data):
        mine = plain(data[name])
        want += [(seq + before, line, good) for seq, line, good in mine]
        before += len(mine)
    assert got == want and said == {candump.NOT_TEXT}


def test_decode_goes_on_after_such_a_line_and_export_stops(spark, tmp_path, capsys):
    (tmp_path / "lamp.dbc").write_text(LAMP)
    (tmp_path / "odd.log").write_bytes(b"(1.0) can7 04D#0200\n(2.0) can\xff7 04D#0300\nrubbish\n(3.0) can7 04D#0400\n")
    words = [str(tmp_path / "lamp.dbc"), str(tmp_path / "odd.log")]
    assert cli.main(["decode", *words]) == 1
    out, err = capsys.readouterr()
    assert out == "1.000000 04D Lamp\n  Dim: 1 %\n3.000000 04D Lamp\n  Dim: 2 %\n"
    assert err.splitlines()[0] == f"buswright: {candump.NOT_TEXT}" and err.splitlines()[1].startswith("buswright: log line 2: ") and "2 line(s) could not be read" in err
    assert cli.main(["export", *words, "-o", str(tmp_path / "x.ld")]) == 2
    assert candump.NOT_TEXT in capsys.readouterr().err and not (tmp_path / "x.ld").exists()


def test_a_pipe_is_decoded_while_it_comes(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "lamp.dbc").write_text(LAMP)
    seen = threading.Event()
    monkeypatch.setattr(cli, "show", lambda rows: [(print(r), seen.set()) for r in rows])
    monkeypatch.setattr(piped, "WAIT", 0.0)
    out, into = os.pipe()
    early = []

    def feed():
        with os.fdopen(into, "wb") as f:
            f.write(b"(1.0) can7 04D#0200\nrubbish\n(2.0) can7 0")
            f.flush()
            early.append(seen.wait(90))
            f.write(b"4D#0300\n\xff\nmore rubbish\n(3.0) can7 04D#0400")

    feeder = threading.Thread(target=feed)
    feeder.start()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(os.fdopen(out, "rb")))
    assert cli.main(["decode", str(tmp_path / "lamp.dbc"), "-", "--format", "csv"]) == 1
    feeder.join()
    text, err = capsys.readouterr()
    # the first row came out while the pipe was open
    assert early == [True]
    assert [r.split(",")[0] for r in text.splitlines()[1:]] == ["1.000000", "2.000000", "3.000000"]
    assert [x.split(":")[1].strip() for x in err.splitlines()[:3]] == ["log line 2", candump.NOT_TEXT, "log line 4"]
    assert "decoded 3 frame(s), 3 line(s) could not be read" in err
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert not [n for n in os.listdir(root) if n.startswith("piped-") and "checkpoint" not in n]


def test_pieces_are_cut_at_line_ends_and_numbered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(piped, "PIECE", 300)
    data = log_bytes(90, 5) + b"(7.0) can7 04D#" + b"0" * 900 + b"\n(8.0) can7 04D#0100"
    spool = piped.Spool(spark, str(tmp_path / "pieces"))
    spool.copy(io.BufferedReader(io.BytesIO(data)))
    assert spool.failed is None
    names = sorted(n for n in os.listdir(tmp_path / "pieces") if n.endswith(".log"))
    pieces = [(tmp_path / "pieces" / n).read_bytes() for n in names]
    assert b"".join(pieces) == data and len(pieces) > 5 and all(p.endswith(b"\n") for p in pieces[:-1])
    want, at = plain(data), 0
    for name, piece in zip(names, pieces, strict=True):
        first_seq, first_line = map(int, name.removesuffix(".log").split("-"))
        assert first_seq == at + 1 and first_line == 1 + sum(line is not None for _, line, _ in want[:at])
        at += len(plain(piece))
    got = []
    piped.read_pipe(spark, io.BufferedReader(io.BytesIO(data)), lambda frames, errors: got.extend((r.seq, r.line_no) for df in (frames, errors) for r in df.collect()))
    assert sorted(got) == [(seq, line) for seq, line, _ in want]


def test_a_pipe_that_breaks_and_a_reader_that_fails_are_raised(spark):
    class Broken(io.RawIOBase):
        def read1(self, n):
            raise OSError("the cable is out")

    with pytest.raises(OSError, match="cable"):
        piped.read_pipe(spark, Broken(), lambda *_: None)

    def fails(*_):
        raise RuntimeError("no paper")

    with pytest.raises(Exception, match="no paper"):
        piped.read_pipe(spark, io.BufferedReader(io.BytesIO(b"x\n")), fails)


# layouts


def bits(s):
    if not s.is_motorola:
        return set(range(s.start_bit, s.start_bit + s.length))
    at, out = s.start_bit, set()
    for _ in range(s.length):
        out.add(at)
        at = at - 1 if at % 8 else at + 15
    return out


def test_overlaps_equal_a_comparison_of_all_bits(spark):
    r = random.Random(3)
    messages = []
    for k in range(60):
        signals = []
        for i in range(r.randrange(0, 9)):
            kind = r.choice([None, None, "m", "m"]) if i else "M"
            signals.append(Signal(f"S{i}", r.randrange(0, 540 if k % 3 == 0 else 64), r.randrange(1, 65 if k % 2 else 12), r.random() < 0.5, False, mux_kind=kind, mux_page=r.randrange(2) if kind == "m" else None))
        messages.append(Message(k + 1, k % 4 == 0, f"M{k}", 8, signals=tuple(signals)))
    c = Catalog(messages, "d")
    want = set()
    for m in messages:
        for i, a in enumerate(m.signals):
            for b in m.signals[i + 1 :]:
                apart = a.mux_kind == b.mux_kind == "m" and a.mux_page != b.mux_page
                if not apart and min(bits(a) & bits(b), default=512) < 512:
                    want.add((m.name, a.name, b.name))
    found = [(r.message, r.first, r.second) for r in check.check(spark, c).where("kind = 'overlap'").collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 60
    listed = [(r.is_extended, r.can_id, r.rank, r.i, r.j) for r in check.check(spark, c).collect()]
    assert listed == sorted(listed)


def test_databases_of_a_table_are_parsed_or_are_errors(spark):
    rows = [("good", LAMP.encode()), ("bad", b"BO_ 9 Pipe: 2 N\n SG_ Flow\n"), ("bytes", b"\xff"), ("none", None), ("empty", b"")]
    messages, signals, errors = parse_texts(spark.createDataFrame(rows, "db string, content binary"))
    assert [(r.db, r.message) for r in messages.collect()] == [("good", "Lamp")] and [(r.signal, r.factor) for r in signals.collect()] == [("Dim", 0.5)]
    assert sorted(r.db for r in errors.collect()) == ["bad", "bytes", "none"]
    labelled = LAMP + 'VAL_ 77 Dim 1 "Half" 2 "Whole" ;\n'
    assert parse_texts(spark.createDataFrame([("x", labelled)], "db string, content string"))[1].select(F.col("labels")).first()[0] == {1: "Half", 2: "Whole"}


def test_overlaps_are_shuffled_whatever_the_size_of_the_signals_table(spark, tmp_path):
    Catalog([Message(1, False, "M", 8, "", (Signal("A", 0, 8), Signal("B", 4, 8)))]).signals(spark).write.parquet(str(tmp_path / "s"))
    found = check.overlaps(spark.read.parquet(str(tmp_path / "s")))
    assert [(r.first, r.second) for r in found.collect()] == [("A", "B")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_databases_are_kept_a_row_a_message_and_a_signal(spark):
    body = "".join(f'BO_ {i} M{i}: 8 X\n SG_ A : 0|8@1+ (1,0) [0|0] "" X\n SG_ B : 8|8@1+ (1,0) [0|0] "" X\n' for i in range(1500))
    messages, signals, errors = parse_texts(spark.createDataFrame([(f"d{i}", body) for i in range(3)] + [("bad", "SG_ A")], "db string, content string"))
    assert (messages.count(), signals.count(), errors.count()) == (4500, 9000, 1)
    assert spark.read.parquet(*signals.inputFiles()).count() == 4500 + 9000 + 1
