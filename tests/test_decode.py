import io
import struct

import pytest
from pyspark.sql import functions as F

from buswright import cli, demo
from buswright.functions.frames import timestamp_text
from buswright.operators import check, decode, encode, resample
from buswright.plans import compiled
from buswright.schemas import FRAMES
from buswright.sinks import ld, text
from buswright.sources import candump, socketcan
from buswright.sources.dbc import Catalog, Message, Signal, parse
from buswright.streaming import live

# A ferry: a message of CAN FD, one of three pages of which a fourth has no signal, and an extended one.
DBC = """BO_ 1301 Hull: 12 BRIDGE
 SG_ Draft : 0|20@1+ (0.001,0) [0|0] "m" LOG
 SG_ Trim : 39|12@0- (0.05,1) [0|0] "deg" LOG
 SG_ Fuel : 64|24@1+ (1,0) [0|0] "l" LOG
BO_ 640 Galley: 8 BRIDGE
 SG_ Cold m0 : 8|16@1+ (1,0) [0|0] "ml" LOG
 SG_ Warm m2 : 12|9@1- (0.5,30) [0|0] "degC" LOG
 SG_ Jet m3 : 20|4@1+ (1,0) [0|0] "" LOG
 SG_ Tap M : 6|2@1+ (1,0) [0|3] "" LOG
BO_ 2148274174 Ramp: 3 BRIDGE
 SG_ Angle : 0|10@1- (0.2,0) [-40|40] "deg" LOG
 SG_ Locked : 10|1@1+ (1,0) [0|1] "" LOG
 SG_ Load : 23|8@0+ (2.5,10) [0|0] "t" LOG
VAL_ 2148274174 Locked 1 "Yes" 0 "No" ;
VAL_ 640 Tap 2 "Warm water" 0 "Off" ;
"""
# What decoding this log must give, worked out by hand.
LOG = """(1912345678.000000) vcan3 515##3B20C0000FF80000070110100
(1912345678.020000) vcan3 280#80B01E0000000000_C

(1912345678.020500) vcan3 000C0FFE#DD0720
(1912345678.030000) vcan3 123#AB
(1912345678.031000) vcan3 000C0FFF#R4
(1912345678.040000) vcan3 00000515#00
(1912345678.050000) vcan3 280#40
(1912345678.060000) vcan3 000C0FFE#2A00
(1912345678.070000) vcan3 515##0A00F00000000000000000000
(1912345678.070000) vcan3 000C0FFE#2A00FF
"""
TEXT = """1912345678.000000 515 Hull
  Draft: 3.25 m
  Trim: 0.6 deg
  Fuel: 70000 l
1912345678.020000 280 Galley [dlc 12]
  Warm: 19.5 degC
  Tap: Warm water (2)
1912345678.020500 000C0FFE Ramp
  Angle: -7 deg
  Locked: Yes (1)
  Load: 90 t
1912345678.050000 280 Galley
  Tap: 1
1912345678.060000 000C0FFE Ramp
  Angle: 8.4 deg
  Locked: No (0)
1912345678.070000 515 Hull
  Draft: 4 m
  Trim: 1 deg
  Fuel: 0 l
1912345678.070000 000C0FFE Ramp
  Angle: 8.4 deg
  Locked: No (0)
  Load: 647.5 t
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "ferry.dbc").write_text(DBC)
    (tmp_path / "ferry.log").write_text(LOG)
    return tmp_path


def frames_of(spark, rows):
    return spark.createDataFrame([(i + 1, i + 1, t, c, e, bytes.fromhex(p), len(p) // 2, None) for i, (t, c, e, p) in enumerate(rows)], FRAMES)


def decoded(spark, dbc, rows):
    return decode.decode_frames(frames_of(spark, rows), parse(dbc)).orderBy("seq", "sig_ix").collect()


def test_decode_prints_frames_with_signals_and_a_tally(spark, files, capsys):
    assert cli.main(["decode", str(files / "ferry.dbc"), str(files / "ferry.log")]) == 0
    out, err = capsys.readouterr()
    assert out == TEXT
    assert err.strip() == "buswright: decoded 7 frame(s), 2 not in the DBC, 1 signal(s) did not fit their frame"


def test_decode_reads_standard_input(spark, files, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(LOG.encode())))
    assert cli.main(["decode", str(files / "ferry.dbc"), "-"]) == 0
    assert capsys.readouterr().out == TEXT


def test_csv_rows_and_lines_that_cannot_be_read(spark, files, capsys):
    (files / "odd.log").write_text("noise\n(4.0) vcan3 280#00F4010000000000_9\n(6.5) vcan3 000C0FFE#DD0720\n(7.0) vcan3 280#0G\n")
    words = [str(files / "ferry.dbc"), str(files / "odd.log")]
    assert cli.main(["decode", *words, "--format", "csv"]) == 1
    out, err = capsys.readouterr()
    lines = out.splitlines()
    assert lines[:3] == [text.HEADER, "4.000000,280,Galley,Cold,500,500,ml,", "4.000000,280,Galley,Tap,0,0,,Off"]
    assert lines[3:5] == ["6.500000,000C0FFE,Ramp,Angle,989,-7,deg,", "6.500000,000C0FFE,Ramp,Locked,1,1,,Yes"]
    assert "log line 1: " in err and "log line 4: " in err and "2 line(s) could not be read" in err
    (files / "rows.csv").write_text(out)
    back = text.read_decoded_csv(spark, str(files / "rows.csv")).collect()
    assert [(r.signal, float(r.timestamp), int(r.raw), r.value, r.label or None) for r in back][-2] == ("Locked", 6.5, 1, 1.0, "Yes")
    assert cli.main(["decode", *words]) == 1
    assert capsys.readouterr().out.splitlines()[0] == "4.000000 280 Galley [dlc 9]"


def test_commands_that_cannot_run(spark, files, capsys):
    assert cli.main(["decode", str(files / "no.dbc"), str(files / "ferry.log")]) == 2
    assert "cannot read" in capsys.readouterr().err
    (files / "bad.dbc").write_text("BO_ 9 Pipe: 2 N\n SG_ Flow\n")
    assert cli.main(["check", str(files / "bad.dbc")]) == 2
    assert "line 2 of the database" in capsys.readouterr().err
    assert cli.main(["export", str(files / "ferry.dbc"), str(files / "ferry.log"), "-o", str(files / "x.ld"), "--rate", "0"]) == 2
    assert capsys.readouterr().err.startswith("buswright: cannot export: 0 Hz")
    for bad in ("-3", "0", "", "later", "nan", "-inf"):
        with pytest.raises(SystemExit):
            cli.main(["live", "x", "can1", "--timeout", bad])


def test_check_lists_problems(spark, files, capsys):
    assert cli.main(["check", str(files / "ferry.dbc")]) == 0
    assert capsys.readouterr().out.strip().endswith("3 message(s), 10 signal(s), 0 problem(s)")
    (files / "yard.dbc").write_text(demo.BROKEN_DBC)
    assert cli.main(["check", str(files / "yard.dbc")]) == 1
    assert capsys.readouterr().out.splitlines()[:-1] == [
        "Pump: signal `Flow` needs 4 byte(s) but the message declares 3",
        "Winch: signals `Rope` and `Pull` overlap",
        "Winch: signals `Angle` and `Tilt` overlap",
        "Crane: signals `Boom` and `Reach` overlap",
        "Mast: signal `Sway` needs 3 byte(s) but the message declares 2",
    ]


def test_bits_past_the_longest_payload_are_not_compared(spark):
    far = lambda name, start: Signal(name, start, 16)
    found = check.check(spark, Catalog([Message(7, False, "Far", 64, signals=(far("P", 500), far("Q", 508), far("R", 520), far("S", 524)))])).collect()
    # P and Q share bits 508 to 511; R and S share only bits that no frame has
    assert [(r.first, r.second) for r in found if r.kind == "overlap"] == [("P", "Q")]
    assert [r.first for r in found if r.kind == "past_dlc"] == ["P", "Q", "R", "S"]


def test_export_writes_the_format(spark, files, capsys):
    out = files / "ferry.ld"
    assert cli.main(["export", str(files / "ferry.dbc"), str(files / "ferry.log"), "-o", str(out), "--rate", "500", "--driver", "Mira", "--venue", "South bay"]) == 1
    err = capsys.readouterr().err.splitlines()
    assert err[0].endswith("8 channels at 500 Hz, 36 samples each, from 9 frames") and err[1].startswith("buswright: 1 signal value(s) dropped")
    content = out.read_bytes()
    assert len(content) == 1762 + 1154 + 124 * 8 + 4 * 8 * 36
    assert content[94:104] == b"07/08/2030" and content[126:134] == b"15:07:58" and content[158:162] == b"Mira" and content[350:359] == b"South bay"
    assert struct.unpack_from("<I", content, 86) == (8,)
    samples = ld.read_samples(content)
    assert list(samples) == ["Warm", "Tap", "Draft", "Trim", "Fuel", "Angle", "Locked", "Load"]
    # Tap is 2 until 50 ms, Fuel drops at the last point, Warm holds throughout
    assert samples["Warm"].tolist() == [19.5] * 36 and samples["Tap"].tolist() == [2.0] * 25 + [1.0] * 11
    assert samples["Fuel"].tolist() == [70000.0] * 35 + [0.0] and samples["Locked"].tolist() == [1.0] * 30 + [0.0] * 6


def test_exports_past_the_format_are_refused(spark, monkeypatch):
    f = frames_of(spark, [(0, 0xC0FFE, True, "0000"), (10_000_000, 0xC0FFE, True, "0000")])
    monkeypatch.setattr(resample, "MAX_SAMPLE_BYTES", 2 * 101 * 4)
    assert resample.sample(f, parse(DBC), 10).points == 101
    monkeypatch.setattr(resample, "MAX_SAMPLE_BYTES", 2 * 101 * 4 - 1)
    with pytest.raises(resample.ExportError, match="takes 808 bytes"):
        resample.sample(f, parse(DBC), 10)
    with pytest.raises(resample.ExportError, match="none of the database"):
        resample.sample(f, parse("BO_ 3 Other: 1 N\n"), 10)


def test_a_page_without_a_multiplexor_is_on_every_frame(spark):
    dbc = 'BO_ 70 Lone: 3 N\n SG_ Only m6 : 16|8@1- (1,0) [0|0] "" L\n'
    assert [(r.signal, r.raw, r.value) for r in decoded(spark, dbc, [(0, 70, False, "0000F0")])] == [("Only", 240, -16.0)]


def test_a_multiplexor_that_does_not_fit_selects_no_page(spark):
    got = decoded(spark, DBC, [(0, 640, False, "")])
    assert [(r.signal, r.status, r.required, r.available) for r in got] == [("Tap", "unfit", 1, 0)]


def test_pages_go_by_the_bits_of_the_selector_not_its_value(spark):
    dbc = 'BO_ 71 Mixed: 4 N\n SG_ Pick M : 8|8@1- (-3,1) [0|0] "" L\n SG_ Low m4 : 16|4@1+ (1,0) [0|0] "" L\n SG_ High m252 : 20|4@1+ (1,0) [0|0] "" L\n'
    got = decoded(spark, dbc, [(0, 71, False, "00049D00"), (1, 71, False, "00FC9D00")])
    assert [(r.signal, r.value) for r in got] == [("Pick", -11.0), ("Low", 13.0), ("Pick", 13.0), ("High", 9.0)]


def test_equal_numbers_of_either_width_are_two_messages(spark):
    dbc = 'BO_ 33 Short: 1 N\n SG_ A : 0|8@1+ (1,0) [0|0] "" L\nBO_ 2147483681 Long: 1 N\n SG_ B : 0|8@1+ (1,0) [0|0] "" L\n'
    assert [r.signal for r in decoded(spark, dbc, [(0, 33, True, "05"), (0, 33, False, "05")])] == ["B", "A"]


def test_fields_of_long_payloads_and_of_64_bits(spark):
    dbc = 'BO_ 9 Fd: 24 N\n SG_ I : 60|64@1+ (1,0) [0|0] "" L\n SG_ M : 58|64@0- (1,0) [0|0] "" L\n SG_ T : 184|8@1+ (2,1) [0|0] "" L\n'
    payload = bytes((37 * i + 11) % 256 for i in range(24))
    little, big = int.from_bytes(payload, "little"), int.from_bytes(payload, "big")
    want = {"I": little >> 60 & (1 << 64) - 1, "M": big >> 192 - 61 - 64 & (1 << 64) - 1, "T": payload[23]}
    for rows in (decoded(spark, dbc, [(0, 9, False, payload.hex())]), compiled.long(frames_of(spark, [(0, 9, False, payload.hex())]), parse(dbc)).collect()):
        assert {r.signal: r.raw % (1 << 64) for r in rows} == want
        values = {r.signal: r.value for r in rows}
        assert values["I"] == float(want["I"]) and values["M"] == float(want["M"] - (1 << 64) * (want["M"] >> 63)) and values["T"] == payload[23] * 2 + 1


def test_a_message_without_signals_is_a_known_frame(spark):
    c = parse("BO_ 12 Mute: 2 N\n")
    f = frames_of(spark, [(3, 12, False, "00"), (4, 13, False, "00")])
    assert decode.tally(f, c).first() == (1, 1, 0)
    assert [r.row for r in text.text_rows(f, c).collect()] == ["0.000003 00C Mute"]
    assert compiled.long(f, c).count() == 0


def test_empty_tables_give_empty_results(spark):
    f = spark.createDataFrame([], FRAMES)
    assert decode.decode_frames(f, parse(DBC)).count() == 0
    assert decode.tally(f, parse(DBC)).first() == (0, 0, 0)
    with pytest.raises(resample.ExportError, match="without frames"):
        resample.sample(f, parse(DBC), 0)


def test_generated_methods_are_small_enough_for_the_jvm_to_compile(spark):
    f = frames_of(spark, [(0, 640, False, "00")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (decode.decode_frames(f, demo.catalog()), compiled.long(f, demo.catalog()), decode.tally(f, demo.catalog())):
            parts = df._jdf.queryExecution().debug().codegenToSeq()
            sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_values_are_printed_at_the_precision_of_their_signals(spark):
    r = __import__("random").Random(2)
    cases = [(0.1 + 0.2, 1), (70.0, 2), (-0.04, 2), (-0.0, 0), (1e3, 3), (250.0, 0), (-0.0, 2), (float(1 << 61), 0), (-9007199254740993.0, 0)]
    cases += [(k * f + o, p) for p, f, o in ((1, 0.1, -40.0), (2, 0.05, 0.25), (3, 0.004, 1.5), (4, 0.0001, 0.0)) for k in (r.randrange(-(1 << 31), 1 << 31) for _ in range(200))]
    df = spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(cases)], "i int, v double, p int")
    got = {x.i: x.t for x in df.select("i", text.value_text(F.col("v"), F.col("p"), 4).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [text._plain(v, p) for v, p in cases]


def test_values_of_any_size_are_printed(spark):
    dbc = 'BO_ 5 Wide: 8 N\n SG_ Huge : 0|16@1+ (1e20,0) [0|0] "" L\n SG_ Fine : 16|16@1+ (1e-16,0) [0|0] "" L\n SG_ Plain : 32|16@1+ (0.5,0) [0|0] "" L\n'
    rows = text.csv_rows(frames_of(spark, [(0, 5, False, "0300070003000000")]), parse(dbc)).collect()
    assert sorted(r.row.split(",")[5] for r in rows) == sorted([f"{3e20:.0f}", "0.0000000000000007", "1.5"])


def test_timestamps_are_exact_to_the_last(spark):
    at = [0, 999_999, 9_007_199_999_999_999, (1 << 53) + 1, (1 << 63) - 1]
    df = spark.createDataFrame([(t,) for t in at], "t long")
    assert [r.s for r in df.select(timestamp_text(F.col("t")).alias("s")).collect()] == [f"{t // 10**6}.{t % 10**6:06d}" for t in at]
    k = resample.index_at_rate(F.col("t"), 0, 7).alias("k")
    assert [r.k for r in df.select(k).collect()] == [-(-t * 7 // 10**6) for t in at]


TANK = 'BO_ 88 Tank: 2 N\n SG_ Fill : 7|16@0+ (1,0) [0|0] "" L\n'


def fills(values):
    return [(t, 88, False, v.to_bytes(2, "big").hex()) for t, v in values]


@pytest.mark.parametrize(
    ("updates", "rate", "want"),
    [
        ([(7_000_000, 40), (7_250_000, 41), (7_600_000, 42)], 4, [40, 41, 41]),
        ([(0, 12), (249_999, 13)], 4, [12]),
        ([(500_000, 3), (4_500_000, 8)], 2, [3] * 8 + [8]),
        ([(60, 1), (60, 2), (60, 3), (1_000_060, 4)], 1, [3, 4]),
        ([(3_000_000, 30), (1_000_000, 10), (2_000_000, 20)], 1, [10, 20, 30]),
    ],
)
def test_samples_hold_the_last_update(spark, updates, rate, want):
    s = resample.sample(frames_of(spark, fills(updates)), parse(TANK), rate)
    assert [r.sample for r in s.samples.orderBy("k").collect()] == want


def test_resampling_matches_a_plain_loop(spark):
    import random

    r = random.Random(11)
    updates = sorted((r.randint(200_000, 3_000_000), r.randint(0, 65535)) for _ in range(250))
    ends = [(t, 89, False, "01") for t in (0, 3_700_000)]
    dbc = TANK + 'BO_ 89 Clock: 1 N\n SG_ Tick : 0|8@1+ (1,0) [0|0] "" L\n'
    for rate in (6, 40, 900):
        s = resample.sample(frames_of(spark, fills(updates) + ends), parse(dbc), rate)
        got = [x.sample for x in s.samples.where("channel_ix = 0").orderBy("k").collect()]
        want, held, i = [], updates[0][1], 0
        for k in range(s.points):
            while i < len(updates) and updates[i][0] <= k * 1_000_000 // rate:
                held, i = updates[i][1], i + 1
            want.append(held)
        assert got == want and s.skipped == 0 and s.frames == 252


def test_the_default_rate_is_a_step_of_the_ladder(spark):
    f = frames_of(spark, fills([(i * 70_000, 1) for i in range(30)]))
    assert resample.default_rate(f).first().rate == 20
    assert resample.default_rate(frames_of(spark, fills([(9, 1)]))).first().rate == 1


def test_names_are_cut_and_numbered():
    names = ld.channel_names([(4, "Boiler supply temperature, east wing", "°C"), (5, "Boiler supply temperature, east win", "m³/h"), (6, "\tPump ", "")])
    assert names == [(4, "Boiler supply temperature, east", "Boiler s", "C"), (5, "Boiler supply temperature, eas_2", "Boiler s", "m/h"), (6, "Pump", "Pump", "")]
    assert ld.date_and_time(3976214399_000000) == ("31/12/2095", "23:59:59")


def test_encoding_is_the_inverse_of_decoding(spark):
    m = parse(DBC).message(0xC0FFE, True)
    rows = spark.createDataFrame([(1, 17.4, 0.0, 60.0), (2, None, 1.0, 20.0), (3, 250.0, 1.0, 1000.0)], "seq long, Angle double, Locked double, Load double")
    out = encode.encode_message(rows, m).select("seq", F.lit(0).cast("long").alias("ts_us"), F.lit(0xC0FFE).cast("long").alias("can_id"), F.lit(True).alias("is_extended"), "payload", "errors").persist()
    assert {r.seq: sorted((e.signal, e.status) for e in r.errors) for r in out.collect()} == {1: [], 2: [], 3: [("Angle", "value_out_of_range"), ("Load", "value_out_of_range")]}
    got = decode.decode_frames(out, parse(DBC)).orderBy("seq", "sig_ix").collect()
    assert [round(r.value, 6) for r in got] == [17.4, 0.0, 60.0, 0.0, 1.0, 20.0, 0.0, 1.0, 10.0]


def test_pages_may_share_bits(spark):
    found = {(r.first, r.second) for r in check.check(spark, parse(demo.BROKEN_DBC)).where("kind = 'overlap'").collect()}
    assert found == {("Rope", "Pull"), ("Angle", "Tilt"), ("Boom", "Reach")}


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.log").write_text("".join(f"({i}.0) can1 263#{i % 256:02X}{n:02X}\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1700")
    try:
        frames, errors = candump.read_log(spark, str(tmp_path))
        got = [(r.seq, r.line_no, r.ts_us // 1_000_000) for r in frames.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(n * 400 + i + 1, i + 1, i) for n in range(3) for i in range(400)] and errors.count() == 0


def test_a_stream_of_logs_is_decoded_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.log").write_text(LOG)
    shown = []
    stream = candump.stream_log(spark, str(tmp_path / "in")).where("kind = 'frame'")
    query, counts = live.run_stream(stream, parse(DBC), lambda rows: shown.extend(decode.decode_frames(rows, parse(DBC)).where("status = 'ok'").collect()), str(tmp_path / "check"))
    live.until_quiet(query, counts, 4)
    assert (counts.frames, counts.unknown, counts.unfit, counts.arrived) == (7, 2, 1, 9) and len(shown) == 17


def test_received_frames_are_unpacked():
    frame = struct.pack("=IB3x8s", 0x81A2B3C4, 3, b"\x88\x02\x09")
    assert socketcan.unpack(frame, 12) == (12, 0x1A2B3C4, True, b"\x88\x02\x09")
    assert socketcan.unpack(struct.pack("=IB3x8s", 0x40000034, 6, b""), 1) is None
    assert socketcan.unpack(struct.pack("=IB3x8s", 0x20000001, 8, b""), 1) is None
    assert socketcan.unpack(struct.pack("=IB3x64s", 0x1F4, 20, b"\x5c" * 20), -1) == (0, 0x1F4, False, b"\x5c" * 20)
