"""Extracting and inserting bit fields of payloads as Catalyst expressions.

``start``, ``length`` and ``motorola`` may be columns, which serve any catalog with
one plan, or Python values, which leave only the branch that the layout needs.

A field starts in byte ``start >> 3`` and, having at most 64 bits, lies in the nine
bytes from there. Eight of them are one 64-bit word and the ninth only matters to
fields that straddle nine bytes. Spark takes shift counts modulo 64, so shifts
that may reach 64 are guarded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int | bool


def _col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def _choose(condition: Value, yes: Column, no: Column) -> Column:
    if isinstance(condition, bool):
        return yes if condition else no
    return F.when(condition, yes).otherwise(no)


def required_bytes(start: Value, length: Value, motorola: Value) -> Column:
    """Bytes that a payload needs for the field to fit."""
    start, length = _col(start), _col(length)
    little = F.shiftright(start + length - 1, 3) + 1
    beyond = F.greatest(length - (start.bitwiseAND(F.lit(7)) + 1), F.lit(0))
    big = F.shiftright(start, 3) + F.shiftright(beyond + 7, 3) + 1
    return _choose(motorola, big, little).cast("int")


def mask(length: Value) -> Column:
    """The lowest ``length`` bits set, for 1 to 64."""
    if isinstance(length, int):
        return F.lit(-1 if length == 64 else (1 << length) - 1).cast("long")
    return _right(F.lit(-1).cast("long"), F.lit(64) - length)


def bit_position(start: Value, index: Column, motorola: Value) -> Column:
    """Where bit ``index`` of a field lies, from its start bit on, in the numbering of databases.

    Motorola fields run from the most significant bit down; counted from each
    byte's top they are contiguous.
    """
    start = _col(start)
    top = lambda p: F.shiftleft(F.shiftright(p, 3), 3) + 7 - p.bitwiseAND(F.lit(7))
    return _choose(motorola, top(top(start) + index), start + index)


class _Window:
    """Nine payload bytes from a field's first, as words; bytes past the end read as zero."""

    def __init__(self, payload: Column, start: Value):
        start = _col(start)
        self.first = F.shiftright(start, 3).cast("int")
        self.bit = start.bitwiseAND(F.lit(7)).cast("int")
        self.digits = F.rpad(F.hex(F.substring(payload, self.first + 1, F.lit(9))), 18, "0")
        self.ninth = F.conv(F.substring(self.digits, 17, 2), 16, 10).cast("long")

    def held(self, motorola: Value) -> Column:
        """The first eight bytes as a word in the field's byte order."""
        first = F.substring(self.digits, 1, 16)
        return bound(word(_choose(motorola, first, F.reverse(first))), lambda x: _choose(motorola, x, swapped_digits(x)))


def word(digits: Column) -> Column:
    """The 64 bits that sixteen hex digits spell."""
    return F.conv(digits, 16, -10).cast("long")


def swapped_digits(x: Column) -> Column:
    """A word with the two hex digits of each byte swapped: what reversing its digits needs to reverse its bytes."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(x.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(low))


def little_word(digits: Column) -> Column:
    """:func:`word` with the bytes in the opposite order."""
    return swapped_digits(word(F.reverse(digits)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it: branches aren't searched for what they repeat."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def payload_words(payload: Column) -> Column:
    """A payload as words of eight bytes, each in either byte order: big, little, big, little and so on.

    The last is filled up with zeros and an empty payload is one word. Payloads of
    eight bytes, which most are, take two conversions.
    """

    def both(digits: Column) -> Column:
        digits = F.rpad(digits, 16, "0")
        return F.array(word(digits), little_word(digits))

    each = F.transform(F.sequence(F.lit(0), F.shiftright(F.length(payload) - 1, 3)), lambda k: both(F.hex(F.substring(payload, 8 * k + 1, F.lit(8)))))
    return F.when(F.length(payload) <= 8, both(F.hex(payload))).otherwise(F.flatten(each))


def placement(start: Value, length: Value, motorola: Value) -> Column:
    """Where a field lies in :func:`payload_words`: struct(at, r, l, a, b, c, mask).

    The field is ``(words[at] >>> r << l | words[at + 2] >>> a << b << c) & mask``. A
    shift by 64 is one by 1 and one by 63, which is how a word drops out.
    """
    start, length = _col(start).cast("int"), _col(length).cast("int")
    first = _choose(motorola, F.shiftleft(F.shiftright(start, 3), 3) + 7 - start.bitwiseAND(F.lit(7)), start)
    offset = first.bitwiseAND(F.lit(63))
    over = F.greatest(offset + length - 64, F.lit(0))
    at = 2 * F.shiftright(first, 6)
    big = F.struct(at.alias("at"), F.greatest(64 - offset - length, F.lit(0)).alias("r"), over.alias("l"), F.when(over > 0, 64 - over).otherwise(0).alias("a"), (over == 0).cast("int").alias("b"), F.when(over > 0, 0).otherwise(63).alias("c"), mask(length).alias("mask"))
    little = F.struct((at + 1).alias("at"), offset.alias("r"), F.lit(0).alias("l"), F.lit(0).alias("a"), F.lit(1).alias("b"), (63 - offset).alias("c"), mask(length).alias("mask"))
    return _choose(motorola, big, little)


def placed_raw(words: Column, place: Column) -> Column:
    """The bits of a field by its :func:`placement`."""
    one, two = F.get(words, place["at"]), F.coalesce(F.get(words, place["at"] + 2), F.lit(0).cast("long"))
    upper = _left(_left(_right(two, place["a"]), place["b"]), place["c"])
    return _left(_right(one, place["r"]), place["l"]).bitwiseOR(upper).bitwiseAND(place["mask"])


def _nine(start: Value, length: Value, motorola: Value) -> bool:
    """Whether a field may need the ninth byte; known only for layouts given as numbers."""
    if isinstance(start, Column) or isinstance(length, Column) or isinstance(motorola, Column):
        return True
    return (7 - start % 8 if motorola else start % 8) + length > 64


def extract_raw(payload: Column, start: Value, length: Value, motorola: Value, fits: Column | None = None) -> Column:
    """The field's bits as an unsigned pattern; null where the payload is too short.

    ``fits`` replaces the length check by one that the caller has at hand. Both byte
    orders are the same shifts of a word and the byte after it with other counts,
    so each is read once.
    """
    if fits is None:
        fits = required_bytes(start, length, motorola) <= F.length(payload)
    w, size = _Window(payload, start), _col(length)
    held = w.held(motorola)
    # bits below the field in the nine bytes, of a Motorola field
    below = F.lit(65) + w.bit - size
    out = _left(_right(held, _choose(motorola, F.greatest(below - 8, F.lit(0)), w.bit)), _choose(motorola, F.greatest(8 - below, F.lit(0)), F.lit(0)))
    if _nine(start, length, motorola):
        # shifted by 64 where no bit of the byte belongs to the field
        down, up, far = _choose(motorola, F.least(below, F.lit(63)), F.lit(0)), _choose(motorola, F.lit(0), F.lit(1)), _choose(motorola, F.lit(0), F.lit(63) - w.bit)
        out = out.bitwiseOR(_left(_left(_right(w.ninth, down), up), far))
    return F.when(fits, out.bitwiseAND(mask(length)))


def insert_status(payload: Column, start: Value, length: Value, motorola: Value, raw: Column) -> Column:
    """'ok', 'raw_out_of_range' for a raw with bits above the field, 'out_of_bounds' for a short payload."""
    wide = raw.bitwiseAND(F.bitwise_not(mask(length))) != 0
    short = required_bytes(start, length, motorola) > F.length(payload)
    return F.when(raw.isNull() | wide, "raw_out_of_range").when(short, "out_of_bounds").otherwise("ok")


def insert_raw(payload: Column, start: Value, length: Value, motorola: Value, raw: Column) -> Column:
    """``payload`` with the field set to ``raw`` and all other bits kept; unchanged where
    :func:`insert_status` isn't ok.

    As in :func:`extract_raw` both byte orders are the same shifts with other counts.
    """
    w, size, low = _Window(payload, start), _col(length), mask(length)
    below = F.lit(65) + w.bit - size
    down, up = _choose(motorola, F.greatest(8 - below, F.lit(0)), F.lit(0)), _choose(motorola, F.greatest(below - 8, F.lit(0)), w.bit)
    inner = lambda x: _left(_right(x, down), up)
    new = w.held(motorola).bitwiseAND(F.bitwise_not(inner(low))).bitwiseOR(inner(raw))
    spelled = lambda x: F.lpad(F.hex(x), 16, "0")
    digits = bound(new, lambda x: _choose(motorola, spelled(x), F.reverse(spelled(swapped_digits(x)))))
    if _nine(start, length, motorola):
        a, b, c = _choose(motorola, F.least(below, F.lit(63)), F.lit(0)), _choose(motorola, F.lit(0), F.lit(1)), _choose(motorola, F.lit(0), F.lit(63) - w.bit)
        outer = lambda x: _right(_right(_left(x, a), b), c).bitwiseAND(F.lit(255))
        ninth = F.lpad(F.hex(w.ninth.bitwiseAND(F.bitwise_not(outer(low))).bitwiseOR(outer(raw))), 2, "0")
    else:
        ninth = F.substring(w.digits, 17, 2)
    held_bytes = F.least(F.length(payload) - w.first, F.lit(9))
    middle = F.unhex(F.substring(F.concat(digits, ninth), F.lit(1), held_bytes * 2))
    rest = F.substring(payload, w.first + 10, F.greatest(F.length(payload) - w.first - 9, F.lit(0)))
    out = F.concat(F.substring(payload, F.lit(1), w.first), middle, rest)
    return F.when(insert_status(payload, start, length, motorola, raw) == "ok", out).otherwise(payload)
