"""Live sessions: when they end, and that each frame that arrived comes out once."""

import socket
import struct
import threading
import time

import pytest

from buswright import cli
from buswright.operators import decode
from buswright.sources import candump, socketcan
from buswright.sources.dbc import parse
from buswright.streaming import live

LAMP = 'BO_ 77 Lamp: 2 N\n SG_ Dim : 0|8@1+ (0.5,0) [0|0] "%" L\n'


def line(n):
    return f"({n}.5) can7 04D#{n:02X}00\n"


def packed(n, can_id=77):
    return struct.pack("=IB3x8s", can_id, 2, bytes([n % 256, 0]))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(folder, name, content):
    """A file that appears whole."""
    (folder / name).write_text(content)
    (folder / name).rename(folder / "in" / name)


def stream(spark, folder):
    return candump.stream_log(spark, str(folder / "in")).where("kind = 'frame'")


def values(rows):
    return [int(2 * r.value) for r in decode.decode_frames(rows, parse(LAMP)).orderBy("seq").collect()]


def test_a_batch_that_takes_longer_than_the_timeout_is_no_silence(spark, folder):
    shown = []

    def slowly(rows):
        got = values(rows)
        if not shown:
            # what comes while a batch is being shown is shown too
            put(folder, "b.log", line(4) + line(5))
        time.sleep(2)
        shown.extend(got)

    put(folder, "a.log", line(1) + line(2) + line(3))
    query, counts = live.run_stream(stream(spark, folder), parse(LAMP), slowly, str(folder / "check"))
    live.until_quiet(query, counts, 0.5)
    assert shown == [1, 2, 3, 4, 5] and counts.arrived == 5 and not query.isActive and query.exception() is None


def test_a_quiet_session_ends_and_a_failed_one_raises(spark, folder):
    query, counts = live.run_stream(stream(spark, folder), parse(LAMP), lambda rows: None, str(folder / "check"))
    began = time.monotonic()
    live.until_quiet(query, counts, 0.5)
    assert counts.arrived == 0 and time.monotonic() - began > 0.5 and not query.isActive

    def fails(rows):
        raise RuntimeError("the printer is on fire")

    put(folder, "a.log", line(1))
    for seconds in (30, None):
        query, counts = live.run_stream(stream(spark, folder), parse(LAMP), fails, str(folder / f"check-{seconds}"))
        with pytest.raises(Exception, match="on fire"):
            live.until_quiet(query, counts, seconds)


def test_a_batch_that_begins_after_the_end_is_not_committed(spark, folder):
    query, counts = live.run_stream(stream(spark, folder), parse(LAMP), lambda rows: None, str(folder / "check"))
    counts.stopping = True
    put(folder, "a.log", line(9))
    with pytest.raises(Exception, match="Stopped"):
        query.awaitTermination()
    shown = []
    query, counts = live.run_stream(stream(spark, folder), parse(LAMP), lambda rows: shown.extend(values(rows)), str(folder / "check"))
    live.until_quiet(query, counts, 0.5)
    assert shown == [9]


def bus(spark, folder, **options):
    spark.dataSource.register(socketcan.SocketCan)
    reader = spark.readStream.format("socketcan").option("interface", f"unix:{folder}/bus").option("log", f"file://{folder}/log")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def send(folder, frames, pause=0.0):
    """Send frames once a receiver is there; give up a little after it has gone."""
    out = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
    until = time.monotonic() + 60
    for frame in frames:
        while time.monotonic() < until:
            try:
                out.sendto(frame, f"{folder}/bus")
                until = time.monotonic() + 5
                break
            except OSError:
                time.sleep(0.05)
        time.sleep(pause)
    out.close()


def test_each_frame_of_a_bus_comes_out_once_though_a_batch_is_lost(spark, tmp_path, monkeypatch):
    shown, fail = [], [True]

    def show(rows):
        got = [(r.seq, r.payload[0]) for r in rows.orderBy("seq").collect()]
        if fail and len(shown) + len(got) > 20:
            fail.clear()
            raise RuntimeError("an executor was lost")
        shown.extend(got)

    first = threading.Thread(target=send, args=(tmp_path, [packed(n) for n in range(60)], 0.01))
    first.start()
    query, counts = live.run_stream(bus(spark, tmp_path), parse(LAMP), show, str(tmp_path / "check"))
    with pytest.raises(Exception, match="an executor was lost"):
        live.until_quiet(query, counts, 5)
    (tmp_path / "bus").unlink()
    first.join()
    before = len(shown)
    again = threading.Thread(target=send, args=(tmp_path, [packed(n) for n in range(60, 90)]))
    again.start()
    query, counts = live.run_stream(bus(spark, tmp_path), parse(LAMP), show, str(tmp_path / "check"))
    live.until_quiet(query, counts, 3)
    again.join()
    # numbers go on without a gap; frames that were sent while no receiver was there were never received
    assert [seq for seq, _ in shown] == list(range(1, len(shown) + 1)) and before < len(shown)
    got = [n for _, n in shown]
    assert got == sorted(set(got)) and set(range(20)) <= set(got) and set(range(60, 90)) <= set(got)
    # committed segments are gone but for the newest
    assert len(list((tmp_path / "log").glob("*.frames"))) <= 2


def test_remote_and_error_frames_keep_a_session_alive_but_give_no_row(spark, tmp_path):
    shown = []
    noise = [struct.pack("=IB3x8s", 0x4000004D, 0, b""), struct.pack("=IB3x8s", 0x20000004, 8, b"")]
    sender = threading.Thread(target=send, args=(tmp_path, [packed(1), *noise * 6, packed(2)], 0.35))
    sender.start()
    query, counts = live.run_stream(bus(spark, tmp_path, keep="true"), parse(LAMP), lambda rows: shown.extend(values(rows)), str(tmp_path / "check"))
    # over four seconds pass between the two frames
    live.until_quiet(query, counts, 2.5)
    sender.join()
    assert shown == [1, 2] and counts.arrived == 2
    segments = socketcan.FrameLog(str(tmp_path / "log")).segments()
    assert [first for _, (first, _, _) in sorted(segments.items())] == [1, 2]


def test_a_missing_segment_and_a_broken_frame_are_errors(spark, tmp_path):
    reader = socketcan._Reader({"interface": "unix:x", "log": str(tmp_path / "log")})
    log = socketcan.FrameLog(str(tmp_path / "log"))
    log.append(1, 1, [(5, 77, False, b"\x01"), (6, 78, True, b"")])
    log.append(3, 3, [(7, 77, False, b"\x02")])
    assert [r for b in reader.read(reader.partitions({"segment": 0}, {"segment": 1})[0]) for r in b.column("seq").to_pylist()] == [1, 2]
    with pytest.raises(ValueError, match="segment 2 of"):
        reader.partitions({"segment": 1}, {"segment": 3})
    a, b = socket.socketpair(socket.AF_UNIX, socket.SOCK_DGRAM)
    receiver = socketcan.Receiver(b)
    a.send(packed(3))
    a.send(b"short")
    # what came before the failure is given first
    assert [r[3][0] for r in receiver.taken(5)[0]] == [3]
    with pytest.raises(ValueError, match="a frame of 5 bytes"):
        for _ in range(50):
            receiver.taken(0.1)
    receiver.close()


def test_the_command_shows_a_bus_until_it_is_quiet(spark, tmp_path, capsys):
    (tmp_path / "lamp.dbc").write_text(LAMP)
    sender = threading.Thread(target=send, args=(tmp_path, [packed(8), packed(1, 5), packed(9)]))
    sender.start()
    assert cli.main(["live", str(tmp_path / "lamp.dbc"), f"unix:{tmp_path}/bus", "--timeout", "2", "--format", "csv"]) == 0
    sender.join()
    out, err = capsys.readouterr()
    rows = out.splitlines()
    assert [r.split(",")[1:6] for r in rows[1:]] == [["04D", "Lamp", "Dim", "8", "4"], ["04D", "Lamp", "Dim", "9", "4.5"]]
    assert "decoded 2 frame(s), 1 not in the DBC" in err
    # an interface that can't be opened is a command that can't run
    assert cli.main(["live", str(tmp_path / "lamp.dbc"), "nosuchbus0", "--timeout", "1"]) == 2
    assert "nosuchbus0" in capsys.readouterr().err
