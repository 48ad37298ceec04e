"""Bus logs in the text format of candump, read as frames and error rows.

Which of the format's rules a line breaks first decides what it is, so a malformed
line becomes a row of its own and the rest of the log is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buswright.functions.bits import bound
from buswright.functions.frames import dlc_to_len, len_to_dlc
from buswright.schemas import CLASSIC_BYTES, ERROR_FLAG, EXTENDED_MAX, FD_BYTES, LENGTH_OF_DLC, STANDARD_MAX

_MAX_U64 = "18446744073709551615"
_MAX_TS = (1 << 63) - 1
#: Blocks of input whose line counts are sent to all tasks, some 30 MB.
BROADCAST_BLOCKS = 200_000
#: What is said of a line whose bytes are no UTF-8.
NOT_TEXT = "a line is not UTF-8 text"


_X = "[0-9A-Fa-f]"
_SIZES = "|".join(["{0,8}", *(f"{{{n}}}" for n in LENGTH_OF_DLC if n > CLASSIC_BYTES)])
#: Lines as loggers write them, which break no rule: a timestamp to the microsecond, an interface, an identifier in
#: its range and whole bytes, as many as a frame has. Every character is a byte.
_PLAIN = (
    rf"^\([0-9]{{1,12}}\.[0-9]{{6}}\) [!-\"$-~]+ (?:[0-7]{_X}{{2}}|[01]{_X}{{7}})#"
    rf"(?:(?:{_X}{_X}){{0,{CLASSIC_BYTES}}}|#{_X}(?:" + "|".join(f"(?:{_X}{_X}){n}" for n in _SIZES.split("|")) + r"))$"
)
_FIELDS = ("kind", "message", "ts_us", "can_id", "is_extended", "payload", "len", "len8_dlc")
_TYPES = ("string", "string", "bigint", "bigint", "boolean", "binary", "int", "int")


def _fields(**values: Column) -> Column:
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in zip(_FIELDS, _TYPES, strict=True)])


def _plain_line(line: Column) -> Column:
    """The fields of a line that :data:`_PLAIN` matches, cut out by position."""
    mark = F.instr(line, "#")
    short = F.substring(line, mark - 4, F.lit(1)) == " "
    width = F.when(short, 3).otherwise(8)
    fd = F.substring(line, mark + 1, F.lit(1)) == "#"
    data = F.substring(line, mark + F.when(fd, 3).otherwise(1), F.lit(2 * FD_BYTES))
    stamp = F.substring(line, F.lit(2), F.instr(line, ")") - 2)
    ts = F.replace(stamp, F.lit("."), F.lit("")).cast("bigint")
    can_id = F.conv(F.substring(line, mark - width, width), 16, 10)
    return _fields(kind=F.lit("frame"), ts_us=ts, can_id=can_id, is_extended=~short, payload=F.unhex(data), len=F.shiftright(F.length(data), 1))


def _steps(known: dict[str, Column], stages: list, last) -> Column:
    """``last`` of all names, where each stage names columns made from those before it; each is worked out once a line."""
    if not stages:
        return last(known)
    new = stages[0](known)
    return bound(F.struct(*[c.alias(n) for n, c in new.items()]), lambda s: _steps(known | {n: s[n] for n in new}, stages[1:], last))


def _odd_line(line: Column) -> Column:
    """The fields of any line, by the first rule that holds for it."""
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\+", ""), "^0+(?=.)", "")
    hexed = lambda x: x.rlike(r"^\+?[0-9A-Fa-f]+$")

    def tokens(k):
        return {"t": F.filter(F.split(k["line"], r"\s+"), lambda t: t != "")}

    def ends(k):
        first = F.get(k["t"], F.lit(0))
        stamp = F.when(F.startswith(first, F.lit("(")), F.regexp_replace(F.substring(first, 2, 1 << 30), r"\)+$", ""))
        return {"stamp": stamp, "last": F.get(k["t"], F.size(k["t"]) - 1)}

    def parts(k):
        micros = F.rpad(F.substring(F.regexp_extract(k["stamp"], r"\.([0-9]*)$", 1), 1, 6), 6, "0").cast("long")
        return {"seconds": F.regexp_extract(k["stamp"], r"^(\+?[0-9]+)(?:\.[0-9]*)?$", 1), "micros": micros, "id": F.regexp_extract(k["last"], r"^([^#]*)#", 1), "rest": F.regexp_extract(k["last"], r"^[^#]*#(.*)$", 1)}

    def numbers(k):
        plain, fd = number(k["id"]), F.startswith(k["rest"], F.lit("#"))
        return {
            "wide": k["seconds"].try_cast("decimal(38,0)"),
            "raw": F.when(hexed(k["id"]) & (F.length(plain) <= 8), F.conv(plain, 16, 10).cast("long")),
            "short": F.length(k["id"]) <= 3,
            "fd": fd,
            "hex": F.when(fd, F.substring(k["rest"], 3, 1 << 30)).otherwise(F.regexp_extract(k["rest"], r"^([^_]*)", 1)),
            "code": F.when(~fd & F.contains(k["rest"], F.lit("_")), F.regexp_extract(k["rest"], r"^[^_]*_(.*)$", 1)),
        }

    def checked(k):
        bad = k["stamp"].isNotNull() & ((k["seconds"] == "") | k["wide"].isNull() | (k["wide"] > F.lit(_MAX_U64).cast("decimal(20,0)")))
        bad = F.coalesce(bad, F.lit(False))
        late = k["wide"] * F.lit(1_000_000) + k["micros"] > F.lit(_MAX_TS)
        digits = number(k["code"])
        return {
            "bad_stamp": bad,
            "ts": F.when(k["stamp"].isNull(), F.lit(0)).when(~bad & ~late, k["seconds"].try_cast("bigint") * 1_000_000 + k["micros"]),
            "dlc": F.when(hexed(k["code"]) & (F.length(digits) == 1), F.conv(digits, 16, 10).cast("int")),
            "n": F.shiftright(F.length(k["hex"]), 1),
        }

    def ruled(k):
        raw, short, fd, n, dlc = k["raw"], k["short"], k["fd"], k["n"], k["dlc"]
        agrees = ((n == 8) & dlc.between(9, 15)) | dlc_to_len(dlc).eqNullSafe(n)
        flagged = ~short & (raw.bitwiseAND(F.lit(ERROR_FLAG)) != 0)
        said, bytes_ = F.concat(F.lit("0x"), F.lower(F.hex(raw))), n.cast("string")
        say = lambda before, x=None, after="": F.concat(F.lit(before), x, F.lit(after)) if x is not None else F.lit(before)
        skip = None
        # the first rule that holds decides; without a text the line is skipped
        rules = [
            (~F.is_valid_utf8(k["line"]), say(NOT_TEXT)),
            (F.size(k["t"]) == 0, skip),
            (k["bad_stamp"], say("no timestamp can be read from `(", k["stamp"], ")`")),
            (k["ts"].isNull(), say("timestamp ", k["stamp"], " is past the last that can be held")),
            (~F.contains(k["last"], F.lit("#")), say("`", k["last"], "` has no `#` between identifier and data")),
            (raw.isNull(), say("`", k["id"], "` is no identifier in hexadecimal digits")),
            (short & (raw > STANDARD_MAX), say("identifier ", said, " is wider than 11 bits")),
            (flagged, skip),
            (~short & (raw > EXTENDED_MAX), say("identifier ", said, " is wider than 29 bits")),
            (fd & ~k["rest"].rlike("^#[0-9A-Fa-f]"), say("`##` is not followed by a digit of flags")),
            (~fd & F.startswith(k["rest"], F.lit("R")), skip),
            (~k["hex"].rlike("^[0-9A-Fa-f]*$"), say("`", k["hex"], "` is no data in hexadecimal digits")),
            (F.length(k["hex"]) % 2 != 0, say("`", k["hex"], "` ends in half a byte")),
            (n > FD_BYTES, say("", bytes_, f" bytes of data are more than the {FD_BYTES} of any frame")),
            (fd & len_to_dlc(n).isNull(), say("frames of ", bytes_, " byte(s) don't exist")),
            (~fd & (n > CLASSIC_BYTES), say("", bytes_, f" byte(s) are more than the {CLASSIC_BYTES} of a frame written with one `#`")),
            (k["code"].isNotNull() & dlc.isNull(), say("`_", k["code"], "` is no length code")),
            (k["code"].isNotNull() & ~agrees, say("length code ", F.concat(dlc.cast("string"), F.lit(" and "), bytes_), " byte(s) of data disagree")),
        ]
        result = None
        for when, text in rules:
            one = F.struct(F.lit("skip" if text is None else "error").alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("message"))
            result = F.when(when, one) if result is None else result.when(when, one)
        return {"rule": result}

    def fields(k):
        frame = _fields(
            kind=F.lit("frame"), ts_us=k["ts"], can_id=k["raw"], is_extended=~k["short"], payload=F.unhex(k["hex"]), len=k["n"],
            len8_dlc=F.when(k["dlc"].between(9, 15) & (k["n"] == 8), k["dlc"]),
        )
        return F.when(k["rule"].isNull(), frame).otherwise(_fields(kind=k["rule"]["kind"], message=k["rule"]["message"]))

    return _steps({"line": line}, [tokens, ends, parts, numbers, checked, ruled], fields)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (line and any other columns) with kind, message and, for kind 'frame', the frame's columns.

    kind is 'frame', 'skip' (blank lines, remote frames, error frames) or 'error'
    with a message. A timestamp past the range of a BIGINT of microseconds is an
    error. Works on batches and streams.

    Lines as loggers write them are known by one pattern and cut by position; only
    others go through the rules. A line's fields are made by a generator, so that a
    filter on them doesn't repeat what they are made from.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    parsed = F.when(line.rlike(_PLAIN), _plain_line(line)).otherwise(_odd_line(line))
    return lines.select(*[F.col(c) for c in lines.columns], F.inline(F.array(parsed)))


def _lines(reader, path: str) -> DataFrame:
    """line, path and block of text files, as a table or a stream. Bytes stay as they are, and only a line feed ends a line."""
    return reader.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def number(text: DataFrame, first_seq: Column | None = None, first_line: Column | None = None) -> DataFrame:
    """path, line_no, seq and line for lines of text files; seq counts on over files in the order of their paths.

    Lines that are no text have no line number and take none from those after
    them. Lines are counted per block, the counts are summed up in block order (a
    row a block), and each block numbers its own lines from there, so no line
    moves unless there are more blocks than :data:`BROADCAST_BLOCKS`; lines of a
    block that has some without a number are sorted among themselves.
    ``first_seq`` and ``first_line`` say from ``path`` where a file's numbers begin,
    where they don't begin anew.
    """
    spark = text.sparkSession
    text = text.select("line", "path", "block", F.monotonically_increasing_id().alias("__at"))
    blocks = text.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"), F.count_if(~F.is_valid_utf8("line")).alias("__bad"))
    order = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    seq = before(F.col("n"), order) if first_seq is None else before(F.col("n"), own) + first_seq - 1
    line = before(F.col("n") - F.col("__bad"), own) + (F.lit(0) if first_line is None else first_line - 1)
    blocks = blocks.select("path", "block", seq.alias("__seq"), line.alias("__line"), "__first", "__bad")
    held = blocks.limit(BROADCAST_BLOCKS + 1).collect()
    few = len(held) <= BROADCAST_BLOCKS
    if few:
        blocks = F.broadcast(spark.createDataFrame(held, blocks.schema))
    at = F.col("__at") - F.col("__first") + 1
    numbered = text.join(blocks, ["path", "block"])
    good = numbered.where("__bad = 0").select("path", (F.col("__line") + at).alias("line_no"), (F.col("__seq") + at).alias("seq"), "line")
    if few and not any(r["__bad"] for r in held):
        return good
    valid = F.is_valid_utf8("line")
    count = F.sum(valid.cast("int")).over(Window.partitionBy("path", "block").orderBy("__at"))
    rest = numbered.where("__bad > 0").select("path", F.when(valid, F.col("__line") + count).alias("line_no"), (F.col("__seq") + at).alias("seq"), "line")
    return good.unionByName(rest)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """:func:`number` for the lines of a log, a folder of logs or a pattern, read in blocks by many tasks."""
    return number(_lines(spark.read, path))


def frames_and_errors(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and error rows of numbered lines. The error of a line that is no text has no line number."""
    rows = parse_lines(numbered)
    frames = rows.where("kind = 'frame'").select("seq", "line_no", "ts_us", "can_id", "is_extended", "payload", "len", "len8_dlc")
    said = F.when(F.col("line_no").isNull(), F.col("message")).otherwise(F.concat(F.lit("log line "), F.col("line_no").cast("string"), F.lit(": "), F.col("message")))
    return frames, rows.where("kind = 'error'").select("seq", "line_no", said.alias("message"))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and error rows of a log, a folder of logs or a pattern."""
    return frames_and_errors(numbered_lines(spark, path))


def stream_log(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """The lines of log files that arrive in a folder, parsed, as a stream; lines have no numbers there."""
    rows = parse_lines(_lines(spark.readStream.option("maxFilesPerTrigger", max_files), folder).select("line"))
    return rows.select(F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("line_no"), *[c for c in rows.columns])


def log_line(ts_us: Column, can_id: Column, is_extended: Column, payload: Column, len8_dlc: Column, interface: str = "can0") -> Column:
    """A frame as a line of a log; payloads over eight bytes are CAN FD records."""
    from buswright.functions.frames import id_text, timestamp_text

    body = F.when(F.length(payload) > CLASSIC_BYTES, F.concat(F.lit("##0"), F.hex(payload))).otherwise(F.concat(F.lit("#"), F.hex(payload)))
    code = F.when(len8_dlc.isNotNull(), F.concat(F.lit("_"), F.hex(len8_dlc))).otherwise("")
    return F.concat(F.lit("("), timestamp_text(ts_us), F.lit(f") {interface} "), id_text(can_id, is_extended), body, code)
