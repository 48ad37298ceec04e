"""Queries over the driver's tables that exercise each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buswright import demo
from buswright.functions import bits, values
from buswright.functions import frames as fr
from buswright.operators import check, decode, encode, resample, summaries
from buswright.plans import compiled
from buswright.session import scratch
from buswright.sinks import ld, text
from buswright.sources import candump, generator
from buswright.sources.dbc import Signal, parse_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_F = demo.FRAMES_SQL


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.frames(_events(spark, sf_dir))


def _byte(i: int, h: str = "h") -> str:
    return f"TRY_CAST('0x' || nullif(substr({h}, {2 * i + 1}, 2), '') AS BIGINT)"


def _little(first: int, count: int, h: str = "h") -> str:
    return "(" + " + ".join(f"{_byte(first + i, h)} * {256**i}" for i in range(count)) + ")"


def _signed(x: str, length: int) -> str:
    return f"(CASE WHEN {x} >= {1 << (length - 1)} THEN {x} - {1 << length} ELSE {x} END)"


# message, identifier, signal index, signal, bytes needed, raw, bits if signed, factor, offset, unit, decimals, label, page
_ZONE = f"({_byte(1)} // 16)"
_LAYOUT = [
    ("Drive", 289, 0, "Torque", 2, _little(0, 2), 16, 0.5, 0, "Nm", 1, None, None),
    ("Drive", 289, 1, "Current", 4, f"({_byte(2)} * 16 + {_byte(3)} // 16)", None, 0.1, -50, "A", 1, None, None),
    ("Drive", 289, 2, "Notch", 4, f"({_byte(3)} % 8)", None, 1, 0, "", 0, None, None),
    ("Drive", 289, 3, "Distance", 8, _little(4, 4), None, 0.125, 0, "km", 3, None, None),
    ("Doors", 1042, 0, "Boarded", 2, f"({_byte(0)} * 4 + {_byte(1)} // 64)", None, 1, 0, "", 0, None, None),
    ("Doors", 1042, 1, "Play", 2, f"({_byte(1)} % 64)", 6, 0.25, 1, "mm", 2, None, None),
    ("Doors", 1042, 2, "State", 3, f"({_byte(2)} % 16)", 4, 1, 0, "", 0, {-2: "Jammed", 0: "Closed", 3: "Open", 5: ""}, None),
    ("Doors", 1042, 3, "Cycles", 7, f"({_byte(4)} * 4096 + {_byte(5)} * 16 + {_byte(6)} // 16)", None, 1, 0, "", 0, None, None),
    ("Climate", 77, 0, "Power", 2, f"({_byte(0)} + ({_byte(1)} % 16) * 256)", None, 0.05, 0, "kW", 2, None, None),
    ("Climate", 77, 1, "CabinAir", 4, f"({_byte(2)} + ({_byte(3)} % 16) * 256)", 12, 0.1, 0, "degC", 1, None, 2),
    ("Climate", 77, 2, "Zone", 2, _ZONE, None, 1, 0, "", 0, {2: "Cabin", 9: "Cold store"}, None),
    ("Climate", 77, 3, "StoreAir", 4, f"({_byte(2)} + ({_byte(3)} % 16) * 256)", 12, 0.1, -20, "degC", 1, None, 9),
    ("Climate", 77, 4, "Humidity", 5, f"({_byte(3)} // 16 + ({_byte(4)} % 16) * 16)", None, 0.5, 0, "%", 1, None, 9),
    ("Faults", 180149761, 0, "Severity", 1, f"(({_byte(0)} // 16) % 8)", None, 1, 0, "", 0, {1: "Minor", 4: "Stop, now", 7: "Unknown"}, None),
    ("Faults", 180149761, 1, "Counter", 8, "(" + " + ".join(f"{_byte(1 + i)} * {256 ** (6 - i)}" for i in range(7)) + ")", None, 1, 0, "", 0, None, None),
]
_KNOWN = "(289, 1042, 77, 180149761, 1500)"


def _decoded_sql() -> str:
    parts = []
    for message, can_id, ix, name, need, raw, signed, factor, offset, unit, _, labels, page in _LAYOUT:
        number = _signed(raw, signed) if signed else raw
        label = "CAST(NULL AS VARCHAR)"
        if labels:
            label = f"CASE {number} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"
        fits = f"len >= {need}"
        on_page = "" if page is None else f" AND len >= 2 AND {_ZONE} = {page}"
        parts.append(
            f"SELECT seq, ts_us, can_id, is_extended, '{message}' AS message, {ix} AS sig_ix, '{name}' AS signal, CASE WHEN {fits} THEN {raw} END AS raw, "
            f"CASE WHEN {fits} THEN CAST({number} AS DOUBLE) * {float(factor)}::DOUBLE + {float(offset)}::DOUBLE END AS value, '{unit}' AS unit, "
            f"CASE WHEN {fits} THEN {label} END AS label, CASE WHEN {fits} THEN 'ok' ELSE 'unfit' END AS status, {need} AS required, len AS available "
            f"FROM frames WHERE can_id = {can_id}{on_page}"
        )
    return "decoded AS (" + "\nUNION ALL ".join(parts) + ")"


_D = _decoded_sql()


@query(f"WITH {_F} SELECT seq, ts_us, can_id, is_extended, h AS payload_hex, len, array_position([0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64], len) - 1 AS dlc FROM frames")
def frame_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return f.select("seq", "ts_us", "can_id", "is_extended", F.hex("payload").alias("payload_hex"), "len", fr.declared_dlc(F.col("payload"), F.col("len8_dlc")).alias("dlc"))


_LENGTHS = "[0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64]"


@query(f"""
WITH x AS (SELECT event_id, event_id % 20 AS dlc, event_id % 70 AS n FROM events)
SELECT event_id, CAST(dlc AS BIGINT) AS dlc, CAST(n AS BIGINT) AS n,
       CASE WHEN dlc <= 15 THEN {_LENGTHS}[dlc + 1] END AS length_of_dlc,
       nullif(coalesce(array_position({_LENGTHS}, n), 0), 0) - 1 AS dlc_of_length,
       CASE WHEN NOT ((n = 8 AND dlc BETWEEN 9 AND 15) OR (dlc <= 15 AND coalesce({_LENGTHS}[dlc + 1] = n, FALSE))) THEN 'dlc_mismatch' WHEN n > 64 THEN 'too_long' ELSE 'ok' END AS status
FROM x""")
def dlc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 20).alias("dlc"), (F.col("event_id") % 70).alias("n"))
    payload = F.unhex(F.repeat(F.lit("A5"), F.col("n").cast("int")))
    return x.select("event_id", "dlc", "n", fr.dlc_to_len(F.col("dlc")).alias("length_of_dlc"), fr.len_to_dlc(F.col("n")).alias("dlc_of_length"), fr.frame_status(payload, F.col("dlc")).alias("status"))


_RAW_ID = "(o_orderkey * 2654435761) % 4294967296"


@query(f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4096 ELSE {_RAW_ID} END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN raw >= 2147483648 THEN raw & 536870911 WHEN raw <= 2047 THEN raw END AS can_id,
       CASE WHEN raw >= 2147483648 THEN TRUE WHEN raw <= 2047 THEN FALSE END AS is_extended,
       CASE WHEN raw <= 2047 THEN raw END AS standard, CASE WHEN raw <= 536870911 THEN raw END AS extended
FROM x""")
def dbc_id_interpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(f"CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4096 ELSE {_RAW_ID} END").alias("raw"))
    found = fr.dbc_id(F.col("raw"))
    return x.select("o_orderkey", "raw", found["can_id"].alias("can_id"), found["is_extended"].alias("is_extended"), fr.standard_id(F.col("raw")).alias("standard"), fr.extended_id(F.col("raw")).alias("extended"))


@query(f"WITH {_F} SELECT seq, ts_us, can_id, is_extended, h AS payload_hex, 'frame' AS kind FROM frames")
def candump_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as log lines and parsed again."""
    line = candump.log_line(F.col("ts_us"), F.col("can_id"), F.col("is_extended"), F.col("payload"), F.col("len8_dlc"))
    parsed = candump.parse_lines(_frames(spark, sf_dir).select("seq", line.alias("line")))
    return parsed.select("seq", "ts_us", "can_id", "is_extended", F.hex("payload").alias("payload_hex"), "kind")


# log lines of every class, with the class and, where it is a frame, the time and payload that they give
_LINES = [
    ("(12.5) can0 123#DEADBEEF", "frame", 12_500_000, "DEADBEEF"),
    ("(12) can0 123#", "frame", 12_000_000, ""),
    ("(0.1234567) can0 00000123#01", "frame", 123_456, "01"),
    ("7ff##1" + "A5" * 12, "frame", 0, "A5" * 12),
    ("   ", "skip", None, None),
    ("(1.0) can0 123#R", "skip", None, None),
    ("(1.0) can0 123#R8", "skip", None, None),
    ("(1.0) can0 20000004#0000000000000008", "skip", None, None),
    ("(1.0) can0 E0000000#00", "skip", None, None),
    ("(1.0) can0 123#0011223344556677_9", "frame", 1_000_000, "0011223344556677"),
    ("(1.0) can0 123#001122_9", "error", None, None),
    ("(1.0) can0 123#001122_3", "frame", 1_000_000, "001122"),
    ("(1.0) can0 123#00112233445566778899", "error", None, None),
    ("(1.0) can0 123##1" + "00" * 9, "error", None, None),
    ("(1.0) can0 123##", "error", None, None),
    ("(1.0) can0 123##0", "frame", 1_000_000, ""),
    ("(1.0) can0 123#012", "error", None, None),
    ("(1.0) can0 123#GG", "error", None, None),
    ("(1.0) can0 123 01", "error", None, None),
    ("(1.0) can0 XYZ#", "error", None, None),
    ("(1.0) can0 800#", "error", None, None),
    ("(1.0) can0 C0000000#", "error", None, None),
    ("(abc) can0 123#", "error", None, None),
    ("(abc) can0 123#R", "error", None, None),
    ("  can0  123   [4]  DE AD BE EF", "error", None, None),
    ("(1.0) can0 123##1" + "00" * 65, "error", None, None),
    ("(18446744073709551616.0) can0 123#", "error", None, None),
]


@query(
    "WITH l(n, kind, ts_us, payload_hex) AS (VALUES "
    + ", ".join(f"({i}, '{k}', {'NULL::BIGINT' if t is None else f'{t}::BIGINT'}, {'NULL' if p is None else repr(p)})" for i, (_, k, t, p) in enumerate(_LINES))
    + f") SELECT event_id, kind, ts_us, payload_hex FROM events JOIN l ON n = event_id % {len(_LINES)}"
)
def candump_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(*[F.lit(x[0]) for x in _LINES])
    at = _events(spark, sf_dir).select("event_id", F.element_at(lines, (F.col("event_id") % len(_LINES) + 1).cast("int")).alias("line"))
    return candump.parse_lines(at).select("event_id", "kind", "ts_us", F.hex("payload").alias("payload_hex"))


@query(f"WITH {_F} SELECT seq, {_little(0, 2)} AS a, CAST(({_little(1, 2)} >> 3) & 8191 AS BIGINT) AS b FROM frames")
def extract_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("payload")
    return _frames(spark, sf_dir).select("seq", bits.extract_raw(p, 0, 16, False).alias("a"), bits.extract_raw(p, F.lit(11), F.lit(13), F.lit(False)).alias("b"))


@query(f"WITH {_F} SELECT seq, {_byte(0)} * 256 + {_byte(1)} AS a, (({_byte(2)} * 65536 + {_byte(3)} * 256 + {_byte(4)}) >> 5) & 32767 AS b FROM frames")
def extract_motorola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field b starts at bit 3 of byte 2 and has 15 bits down to bit 5 of byte 4."""
    p = F.col("payload")
    return _frames(spark, sf_dir).select("seq", bits.extract_raw(p, 7, 16, True).alias("a"), bits.extract_raw(p, F.lit(19), F.lit(15), F.lit(True)).alias("b"))


_REV9 = " || ".join(f"substr(h2, {2 * i + 1}, 2)" for i in range(8, -1, -1))


@query(f"""WITH {_F}, two AS (SELECT seq, CASE WHEN len = 8 THEN h || reverse(h) END AS h2 FROM frames)
SELECT seq, CAST((('0x' || {_REV9})::UHUGEINT >> 4) & 18446744073709551615::UHUGEINT AS VARCHAR) AS intel,
       CAST((('0x' || substr(h2, 1, 18))::UHUGEINT >> 4) & 18446744073709551615::UHUGEINT AS VARCHAR) AS motorola FROM two""")
def extract_nine_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).withColumn("p", F.unhex(F.concat(F.hex("payload"), F.reverse(F.hex("payload")))))
    raw = [bits.extract_raw(F.col("p"), s, 64, m) for s, m in ((4, False), (3, True))]
    return f.select("seq", values.unsigned_text(raw[0]).alias("intel"), values.unsigned_text(raw[1]).alias("motorola"))


@query(f"WITH {_F} SELECT seq, {_signed('x', 16)} AS a, {_signed('(x % 4096)', 12)} AS b FROM (SELECT seq, {_little(0, 2)} AS x FROM frames)")
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bits.extract_raw(F.col("payload"), 0, 16, False)
    return _frames(spark, sf_dir).select("seq", values.sign_extend(x, 16).alias("a"), values.sign_extend(x, F.lit(12)).alias("b"))


@query(f"WITH {_F} SELECT seq, CAST(x AS DOUBLE) * 0.1::DOUBLE - 40::DOUBLE AS a, CAST({_signed('x', 16)} AS DOUBLE) * 0.25::DOUBLE + 3::DOUBLE AS b FROM (SELECT seq, {_little(0, 2)} AS x FROM frames)")
def scale_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bits.extract_raw(F.col("payload"), 0, 16, False)
    return _frames(spark, sf_dir).select("seq", values.scale(x, 16, False, 0.1, -40.0).alias("a"), values.scale(x, F.lit(16), F.lit(True), F.lit(0.25), F.lit(3.0)).alias("b"))


@query(f"WITH {_F}, {_D} SELECT seq, signal, raw, label FROM decoded WHERE signal IN ('State', 'Severity', 'Zone') AND status = 'ok'")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_frames(_frames(spark, sf_dir), demo.catalog().select(["State", "Severity", "Zone"])).where("status = 'ok'").select("seq", "signal", "raw", "label")


@query(f"WITH {_F}, {_D} SELECT seq, signal, raw, value, status FROM decoded WHERE message = 'Climate'")
def mux_page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of multiplexed frames, whichever page they select or don't."""
    return decode.decode_frames(_frames(spark, sf_dir), demo.catalog()).where("message = 'Climate'").select("seq", "signal", "raw", "value", "status")


@query(f"WITH {_F}, {_D} SELECT seq, min(raw) FILTER (signal = 'Zone') AS selector, count(*) AS signals FROM decoded WHERE message = 'Climate' GROUP BY seq HAVING min(raw) FILTER (signal = 'Zone') NOT IN (2, 9)")
def mux_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose selector names a page that no signal has: only what is on all pages is decoded."""
    d = decode.decode_frames(_frames(spark, sf_dir), demo.catalog()).where("message = 'Climate'")
    per = d.groupBy("seq").agg(F.min(F.when(F.col("signal") == "Zone", F.col("raw"))).alias("selector"), F.count(F.lit(1)).alias("signals"))
    return per.where("selector NOT IN (2, 9)")


@query(f"WITH {_F}, {_D} SELECT seq, signal, status, required, available FROM decoded WHERE message = 'Climate' AND status = 'unfit'")
def mux_unfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode.decode_frames(_frames(spark, sf_dir), demo.catalog())
    return d.where("message = 'Climate' AND status = 'unfit'").select("seq", "signal", "status", "required", "available")


@query(f"WITH {_F}, {_D} SELECT seq, message, signal, raw, status, required, available FROM decoded WHERE available < 8")
def short_frame_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_frames(_frames(spark, sf_dir), demo.catalog()).where("available < 8").select("seq", "message", "signal", "raw", "status", "required", "available")


@query(f"WITH {_F} SELECT seq, can_id FROM frames WHERE can_id NOT IN {_KNOWN}")
def unknown_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.unknown_frames(_frames(spark, sf_dir), demo.catalog()).select("seq", "can_id")


@query(f"WITH {_F}, {_D} SELECT count(*) FILTER (can_id IN {_KNOWN}) AS frames, count(*) FILTER (can_id NOT IN {_KNOWN}) AS unknown, (SELECT count(*) FROM decoded WHERE status = 'unfit') AS unfit FROM frames")
def decode_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.tally(_frames(spark, sf_dir), demo.catalog())


@query(f"WITH {_F}, {_D} SELECT * FROM decoded")
def decode_frame_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_frames(_frames(spark, sf_dir), demo.catalog())


@query(f"WITH {_F}, {_D} SELECT seq, ts_us, can_id, is_extended, message, sig_ix, signal, raw, value, unit, label FROM decoded WHERE status = 'ok'")
def decode_compiled_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled.long(_frames(spark, sf_dir), demo.catalog())


@query(f"WITH {_F}, {_D} SELECT seq, ts_us, " + ", ".join(f"max(value) FILTER (signal = '{x[3]}') AS \"{x[3]}\"" for x in _LAYOUT if x[0] == "Climate") + " FROM decoded WHERE message = 'Climate' GROUP BY seq, ts_us")
def decode_compiled_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled.wide(_frames(spark, sf_dir), demo.catalog().message(77))


_TIME = "CAST(ts_us // 1000000 AS VARCHAR) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')"


_ID = "CASE WHEN is_extended THEN printf('%08X', can_id) ELSE printf('%03X', can_id) END"
# the value with its signal's decimals, without trailing zeros
_DECIMALS = "CASE signal " + " ".join(f"WHEN '{x[3]}' THEN {x[10]}" for x in _LAYOUT) + " END"
_SHOWN = f"regexp_replace(CASE {_DECIMALS} WHEN 0 THEN printf('%.0f', value) WHEN 1 THEN rtrim(rtrim(printf('%.1f', value), '0'), '.') WHEN 2 THEN rtrim(rtrim(printf('%.2f', value), '0'), '.') ELSE rtrim(rtrim(printf('%.3f', value), '0'), '.') END, '^-0$', '0')"


@query(f"""WITH {_F}, {_D} SELECT seq, sig_ix, {_TIME} || ',' || {_ID} || ',' || message || ',' || signal || ',' || CAST(raw AS VARCHAR) || ',' || {_SHOWN} || ',' || unit
       || ',' || CASE WHEN contains(coalesce(label, ''), ',') THEN '"' || label || '"' ELSE coalesce(label, '') END AS row FROM decoded WHERE status = 'ok'""")
def render_csv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.csv_rows(_frames(spark, sf_dir), demo.catalog())


@query(f"""WITH {_F}, {_D}, rows AS (
  SELECT seq, -1 AS sig_ix, {_TIME} || ' ' || {_ID} || ' ' || CASE can_id WHEN 289 THEN 'Drive' WHEN 1042 THEN 'Doors' WHEN 77 THEN 'Climate' ELSE 'Faults' END
         || CASE WHEN len = 8 AND seq % 7 = 0 THEN ' [dlc ' || CAST(9 + seq % 6 AS VARCHAR) || ']' ELSE '' END AS row FROM frames WHERE can_id IN {_KNOWN}
  UNION ALL
  SELECT seq, sig_ix, '  ' || signal || ': ' || CASE WHEN label IS NULL THEN v ELSE label || ' (' || v || ')' END
  FROM (SELECT *, {_SHOWN} || CASE WHEN unit = '' THEN '' ELSE ' ' || unit END AS v FROM decoded WHERE status = 'ok')
) SELECT * FROM rows""")
def render_text_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their signals as the decode command prints them; every seventh frame of eight bytes declares another code."""
    code = F.when((F.col("len") == 8) & (F.col("seq") % 7 == 0), (9 + F.col("seq") % 6).cast("int"))
    return text.text_rows(_frames(spark, sf_dir).withColumn("len8_dlc", code), demo.catalog())


_BAD_LINES = ["(1.0) can0 123#R", "(1.0) can0 800#", "no frame here", ""]


@query(f"""WITH {_F}, x AS (SELECT row_number() OVER (ORDER BY seq) AS line, *,
       CASE WHEN seq % 10 <> 0 THEN 'frame' WHEN (seq // 10) % 4 IN (1, 2) THEN 'error' ELSE 'skip' END AS kind FROM frames)
SELECT line AS seq, kind, CASE WHEN kind = 'frame' THEN ts_us END AS ts_us, CASE WHEN kind = 'frame' THEN can_id END AS can_id,
       CASE WHEN kind = 'frame' THEN is_extended END AS is_extended, CASE WHEN kind = 'frame' THEN h END AS payload_hex FROM x WHERE kind <> 'skip'""")
def log_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files written from all events, with other lines in place of every tenth, and read again with numbered lines."""
    f = _frames(spark, sf_dir)
    line = candump.log_line(F.col("ts_us"), F.col("can_id"), F.col("is_extended"), F.col("payload"), F.col("len8_dlc"))
    bad = F.element_at(F.array(*[F.lit(x) for x in _BAD_LINES]), F.expr("CAST(seq div 10 % 4 + 1 AS INT)"))
    path = scratch(spark, "log-files")
    f.orderBy("seq").select(F.when(F.col("seq") % 10 == 0, bad).otherwise(line).alias("line")).write.text(path)
    frames, errors = candump.read_log(spark, path)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ts_us", "long"), ("can_id", "long"), ("is_extended", "boolean"), ("payload_hex", "string"))]
    good = frames.select("seq", F.lit("frame").alias("kind"), "ts_us", "can_id", "is_extended", F.hex("payload").alias("payload_hex"))
    return good.unionByName(errors.select("seq", F.lit("error").alias("kind"), *none))


@query(f"SELECT ts_us, CAST(ts_us // 1000000 AS VARCHAR) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') AS text FROM (SELECT 9223372036854775807 - event_id * 7919 * 1000003 AS ts_us FROM events UNION ALL SELECT event_id * 999999 FROM events)")
def timestamp_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps up to the largest, past the numbers that doubles hold."""
    e = _events(spark, sf_dir)
    ts = e.select((F.lit((1 << 63) - 1) - F.col("event_id") * 7919 * 1000003).alias("ts_us")).union(e.select(F.col("event_id") * 999999))
    return ts.select("ts_us", fr.timestamp_text(F.col("ts_us")).alias("text"))


@query(f"""WITH {_F}, x AS (SELECT seq, h, len >= 3 AS fits, (seq * 31) % 4096 AS new FROM frames)
SELECT seq, CASE WHEN fits THEN new END AS raw, CASE WHEN fits THEN 'ok' ELSE 'out_of_bounds' END AS status,
       CASE WHEN fits THEN substr(h, 1, 2) || printf('%02X', new & 255) || printf('%02X', ({_byte(2)} & 240) | (new >> 8)) || substr(h, 7) ELSE h END AS little,
       CASE WHEN fits THEN substr(h, 1, 2) || printf('%02X', ({_byte(1)} & 240) | (new >> 8)) || printf('%02X', new & 255) || substr(h, 7) ELSE h END AS big FROM x""")
def insert_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 12-bit field of either byte order written over a payload; what is read back is what was written."""
    p, new = F.col("payload"), F.col("new")
    f = _frames(spark, sf_dir).select("seq", "payload", (F.col("seq") * 31 % 4096).alias("new"))
    f = f.withColumn("l", bits.insert_raw(p, 8, 12, False, new)).withColumn("b", bits.insert_raw(p, 11, 12, True, new))
    f = f.withColumn("raw", bits.extract_raw(F.col("l"), 8, 12, False)).withColumn("other", bits.extract_raw(F.col("b"), 11, 12, True))
    status = F.when(F.col("raw").isNull(), bits.insert_status(p, 8, 12, False, new)).when((F.col("raw") == new) & (F.col("other") == new), "ok").otherwise("differs")
    return f.select("seq", "raw", status.alias("status"), F.hex("l").alias("little"), F.hex("b").alias("big"))


@query("""SELECT c_custkey, CASE WHEN abs(round(c_acctbal * 2)) < 32768 THEN CAST(round(c_acctbal * 2) AS BIGINT) & 65535 END AS raw FROM (SELECT c_custkey, c_acctbal FROM customer)""")
def encode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Signal("Balance", 0, 16, False, True, 0.5, 0.0)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", values.unscale(F.col("c_acctbal"), s.length, s.is_signed, s.factor, s.offset).alias("raw"))


@query(f"""WITH {_F} SELECT seq, CASE WHEN ts_us % 3 = 1 THEN 'value_out_of_range' WHEN len < 4 THEN 'out_of_bounds' ELSE 'ok' END AS status,
       CASE WHEN ts_us % 3 = 1 OR len < 4 THEN h ELSE substr(h, 1, 4) || printf('%02X', (seq % 256)) || '00' || substr(h, 9) END AS payload_hex FROM (SELECT * REPLACE (seq AS ts_us) FROM frames)""")
def encode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Signal("Level", 16, 16, False, False, 0.5, -10.0)
    value = F.when(F.col("seq") % 3 == 1, F.lit(-11.0)).otherwise((F.col("seq") % 256) * 0.5 - 10)
    e = encode.encode_signal(F.col("payload"), value, s)
    return _frames(spark, sf_dir).withColumn("e", e).select("seq", "e.status", F.hex("e.payload").alias("payload_hex"))


_BITS_SQL = f"""WITH {demo.DATABASES_SQL}, b AS (SELECT *, [CASE WHEN motorola = 0 THEN start + i
       ELSE ((start // 8 * 8 + 7 - start % 8 + i) // 8) * 8 + 7 - (start // 8 * 8 + 7 - start % 8 + i) % 8 END FOR i IN range(n)] AS bits FROM s)"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, signals and errors of databases written as text from the parts."""
    return parse_texts(demo.databases(spark.read.parquet(f"{sf_dir}/part.parquet")))


@query(f"""{_BITS_SQL} SELECT db, message, name AS first, CAST(list_max(bits) // 8 + 1 AS INTEGER) AS required, CAST(dlc AS INTEGER) AS dlc,
       message || ': signal `' || name || '` needs ' || CAST(list_max(bits) // 8 + 1 AS VARCHAR) || ' byte(s) but the message declares ' || CAST(dlc AS VARCHAR) AS text FROM b WHERE list_max(bits) // 8 + 1 > dlc""")
def check_past_dlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check_layout(_parsed(spark, sf_dir)[1]).where("kind = 'past_dlc'").select("db", "message", "first", "required", "dlc", "text")


@query(f"""{_BITS_SQL} SELECT x.db, x.message, x.name AS first, y.name AS second, x.message || ': signals `' || x.name || '` and `' || y.name || '` overlap' AS text
FROM b x JOIN b y ON x.k = y.k AND x.ix < y.ix WHERE list_has_any(x.bits, y.bits) AND (x.page IS NULL OR y.page IS NULL OR x.page = y.page)""")
def check_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check_layout(_parsed(spark, sf_dir)[1]).where("kind = 'overlap'").select("db", "message", "first", "second", "text")


@query(f"""WITH {_F}, c AS (SELECT can_id, count(*) AS n FROM frames GROUP BY can_id), s AS (SELECT min(ts_us) AS start_us, max(ts_us) AS end_us FROM frames), x AS (SELECT start_us, end_us, (max(n) - 1) / ((end_us - start_us) / 1000000.0::DOUBLE) AS fastest FROM c, s GROUP BY start_us, end_us)
SELECT start_us, end_us, fastest, coalesce(list_min(list_filter([1,2,5,10,20,25,50,100,200,500,1000], lambda r: r >= fastest)), 1000) AS rate FROM x""")
def default_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.default_rate(_frames(spark, sf_dir))


_HOUR = 3_600_000_000


@query(f"""WITH {_F}, u AS (SELECT can_id, ts_us, seq, len FROM frames), s AS (SELECT min(ts_us) AS a, max(ts_us) AS b FROM u),
g AS (SELECT k, a + k * {_HOUR} AS at FROM s, unnest(range((b - a) // {_HOUR} + 1)) AS t(k)),
c AS (SELECT DISTINCT can_id FROM u), f AS (SELECT can_id, arg_min(seq, (ts_us, seq)) AS first_seq FROM u GROUP BY can_id)
SELECT gc.can_id, CAST(gc.k AS BIGINT) AS k, coalesce(u.seq, f.first_seq) AS sample FROM (SELECT * FROM g, c) gc ASOF LEFT JOIN u ON gc.can_id = u.can_id AND gc.at >= u.ts_us JOIN f ON f.can_id = gc.can_id""")
def resample_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type at every hour, the first one's before that."""
    f = _frames(spark, sf_dir).withColumn("sample", F.col("seq"))
    about = resample.span(f).first()
    k = F.call_function("div", F.col("ts_us") - F.lit(about.start_us - _HOUR + 1), F.lit(_HOUR))
    points = (about.end_us - about.start_us) // _HOUR + 1
    return resample.hold(f, ["can_id"], k, points, "sample").select("can_id", "k", "sample")


@query(f"""WITH {_F}, {_D}, o AS (SELECT signal, ts_us, seq, value FROM decoded WHERE status = 'ok'), s AS (SELECT min(ts_us) AS a, max(ts_us) AS b FROM frames),
g AS (SELECT k, a + k * 86400000000 AS at FROM s, unnest(range((b - a) // 86400000000 + 1)) AS t(k)),
f AS (SELECT signal, arg_min(value, (ts_us, seq)) AS v FROM o GROUP BY signal)
SELECT gc.signal, CAST(gc.k AS BIGINT) AS k, coalesce(o.value, gc.v) AS value FROM (SELECT * FROM g, f) gc ASOF LEFT JOIN o ON gc.signal = o.signal AND gc.at >= o.ts_us""")
def resample_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    about, day = resample.span(f).first(), 86_400_000_000
    k = F.call_function("div", F.col("ts_us") - F.lit(about.start_us - day + 1), F.lit(day))
    d = decode.decode_frames(f, demo.catalog()).where("status = 'ok'")
    return resample.hold(d, ["signal"], k, (about.end_us - about.start_us) // day + 1, "value").select("signal", "k", "value")


@query(f"""WITH {_F}, {_D} SELECT message, signal, count(*) AS n, min(value) AS minimum, max(value) AS maximum, arg_max(value, (abs(value), -seq)) AS peak,
       bool_and(value = floor(value)) AND count(DISTINCT value) <= 12 AS stepped FROM decoded WHERE status = 'ok' GROUP BY message, signal""")
def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.channel_summary(decode.decode_frames(_frames(spark, sf_dir), demo.catalog()))


@query(f"WITH {_F}, {_D} SELECT count(DISTINCT (ts_us, can_id, is_extended)) AS frames FROM decoded WHERE status = 'ok'")
def decoded_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.frame_count(decode.decode_frames(_frames(spark, sf_dir), demo.catalog()))


@query(f"WITH {_F}, {_D} SELECT message, signal, list(ts_us ORDER BY ts_us, seq)[1] AS first_ts, len(list(value)) AS n, list(value ORDER BY ts_us, seq)[-1] AS last_value FROM decoded WHERE status = 'ok' GROUP BY message, signal")
def signal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summaries.series(decode.decode_frames(_frames(spark, sf_dir), demo.catalog()))
    return s.groupBy("message", "signal").agg(
        F.min_by(F.element_at("ts_us", 1), "piece").alias("first_ts"), F.sum(F.size("value")).alias("n"), F.max_by(F.element_at("value", -1), "piece").alias("last_value")
    )


@query(f"WITH {_F}, {_D} SELECT message, signal, seq, ts_us, before, value FROM (SELECT *, lag(value) OVER (PARTITION BY message, signal ORDER BY ts_us, seq) AS before FROM decoded WHERE status = 'ok') WHERE value < before")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.monotonic_violations(decode.decode_frames(_frames(spark, sf_dir), demo.catalog()))


_PIXELS = 200


@query(f"""WITH {_F}, {_D}, s AS (SELECT min(ts_us) AS a, (max(ts_us) - min(ts_us)) // {_PIXELS} + 1 AS w FROM frames)
SELECT message, signal, CAST((ts_us - a) // w AS BIGINT) AS "column", count(*) AS n, min(value) AS minimum, max(value) AS maximum,
       arg_min(value, (ts_us, seq)) AS "first", arg_max(value, (ts_us, seq)) AS "last" FROM decoded, s WHERE status = 'ok' GROUP BY ALL""")
def plot_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    about = resample.span(f).first()
    return summaries.panels(decode.decode_frames(f, demo.catalog()), about.start_us or 0, about.end_us or 0, _PIXELS)


_TURNS = 15


def _generated_sql() -> str:
    """Expected raw values of each signal, by the formula of its wave, without any payload."""
    sent, cases = generator.sent(demo.catalog()), []
    for i, m in enumerate(sent):
        shown = generator.pages(m)
        for s in m.signals:
            top, a, b, c = generator.wave(m.name, s.name, s.length)
            raw, on = f"abs((c_custkey * {a} + t * {b} + {c}) % {2 * top} - {top})", "true"
            if s.mux_kind == "M":
                raw = f"{shown}[(c_custkey + t) % {len(shown)} + 1]"
            if s.mux_kind == "m":
                on = f"(c_custkey + t) % {len(shown)} = {shown.index(s.mux_page)}"
            cases.append(f"SELECT '{m.name}' AS message, '{s.name}' AS signal, t * {len(sent)} + {i} AS n, {raw} AS raw FROM c WHERE {on}")
    return f"""WITH c AS (SELECT c_custkey, unnest(range({_TURNS})) AS t FROM customer), r AS ({" UNION ALL ".join(cases)})
SELECT message, signal, count(*) AS n, CAST(sum(raw) AS BIGINT) AS raws, CAST(max(n) * 1000 AS BIGINT) AS last_us FROM r GROUP BY message, signal"""


@query(_generated_sql())
def generated_log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made for each customer, as lines of text, parsed and decoded."""
    c, sent = spark.read.parquet(f"{sf_dir}/customer.parquet"), len(generator.sent(demo.catalog()))
    # the table is one row group, which one task reads, and each row becomes many
    c = c.select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    made = generator.generate(c.select(F.col("c_custkey").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(_TURNS * sent - 1))).alias("n")), demo.catalog())
    line = candump.log_line(F.col("ts_us"), F.col("can_id"), F.col("is_extended"), F.col("payload"), F.col("len8_dlc"))
    frames = candump.parse_lines(made.select("seq", "line_no", line.alias("line"))).where("kind = 'frame'")
    decoded = decode.decode_frames(frames, demo.catalog()).where("status = 'ok'")
    return decoded.groupBy("message", "signal").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raws"), F.max("ts_us").alias("last_us"))


@query(f"WITH {_F}, {_D} SELECT DISTINCT can_id, signal FROM decoded WHERE status = 'ok'")
def carried_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.carried_signals(decode.decode_frames(_frames(spark, sf_dir), demo.catalog()))


@query(f"""WITH {demo.DATABASES_SQL} SELECT db, count(DISTINCT k) AS messages, count(DISTINCT k) FILTER (is_extended) AS extended, count(*) AS signals,
       CAST(sum(motorola) AS BIGINT) AS motorola, CAST(sum(signed) AS BIGINT) AS signed, count(page) AS paged, count(DISTINCT n) AS widths FROM s GROUP BY db""")
def catalog_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, signals, _ = _parsed(spark, sf_dir)
    return summaries.catalog_features(messages, signals)


@query(f"""WITH {demo.DATABASES_SQL} SELECT db, count(DISTINCT k) AS messages, count(*) AS signals, count(page) AS paged, NULL AS error FROM s GROUP BY db
UNION ALL SELECT DISTINCT 'shop' || CAST(p_partkey // {demo.PARTS} AS VARCHAR), 0, 0, 0, 'line 2 of the database: SG_ ends before its `:`' FROM part WHERE (p_partkey // {demo.PARTS}) % {demo.BAD_ONE} = 5""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases that can be read and those that can't, by name."""
    return summaries.corpus_report(*_parsed(spark, sf_dir))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y') AS date, strftime(ts, '%H:%M:%S') AS time FROM events")
def ld_header_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return e.select("event_id", ld.date_column(F.col("t")).alias("date"), ld.time_column(F.col("t")).alias("time"))


@query(f"WITH {_F}, {_D} SELECT message, signal, status, count(*) AS n, CAST(sum(CAST(raw AS HUGEINT)) AS VARCHAR) AS raws FROM decoded GROUP BY message, signal, status")
def stream_decode_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, a file or a folder of part files, as a stream, decoded by the same function as a batch."""
    schema = _events(spark, sf_dir).schema
    # a stream takes a single file only by a pattern; a folder of part files comes in several batches
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{sf_dir}/events.parque[t]")
    decoded = decode.decode_frames(demo.frames(stream), demo.catalog()).select("message", "signal", "status", "raw")
    path = scratch(spark, "stream-decoded")
    q = decoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "stream-checkpoint")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(decoded.schema).parquet(path).groupBy("message", "signal", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw").cast("decimal(20,0)")).cast("string").alias("raws"))
