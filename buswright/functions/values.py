"""Physical values and labels of raw patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buswright.functions.bits import Value, _choose, _col, _left, mask

_TWO_63, _TWO_64 = 9223372036854775808.0, "18446744073709551616"


def sign_extend(raw: Column, length: Value) -> Column:
    """The two's complement number that the lowest ``length`` bits hold."""
    shift = F.lit(64) - _col(length)
    return F.call_function("shiftright", _left(raw, shift), shift.cast("int"))


def unsigned_text(raw: Column) -> Column:
    """A pattern as an unsigned decimal number."""
    wide = raw.cast("decimal(20,0)") + F.lit(_TWO_64).cast("decimal(20,0)")
    return F.when(raw >= 0, raw.cast("string")).otherwise(wide.cast("decimal(20,0)").cast("string"))


def unsigned_double(raw: Column) -> Column:
    """The double next to an unsigned pattern: its upper 63 bits, the last of which remembers the one that goes, doubled."""
    halved = F.shiftrightunsigned(raw, 1).bitwiseOR(raw.bitwiseAND(F.lit(1)))
    return F.when(raw >= 0, raw.cast("double")).otherwise(halved.cast("double") * 2)


def scale(raw: Column, length: Value, signed: Value, factor: Value, offset: Value) -> Column:
    """Physical value of a raw pattern: number times factor, plus offset."""
    number = _choose(signed, sign_extend(raw, length).cast("double"), unsigned_double(raw))
    return number * _col(factor) + _col(offset)


def unscale(value: Column, length: Value, signed: Value, factor: Value, offset: Value) -> Column:
    """The pattern nearest to a physical value, halves away from zero; null where none fits."""
    size = _col(length)
    exact = F.try_divide(value - _col(offset), _col(factor))
    finite = ~F.isnan(exact) & (F.abs(exact) < F.lit(1e300))
    # doubles from 2**52 on have no fraction
    number = F.when(F.abs(exact) < F.lit(4503599627370496.0), F.round(exact)).otherwise(exact)
    limit = F.pow(F.lit(2.0), size.cast("double"))
    half = limit / 2
    plain = F.when((number >= 0) & (number < F.lit(_TWO_63)), number.cast("long"))
    upper = F.when((number >= F.lit(_TWO_63)) & (number < limit), (number - F.lit(_TWO_63)).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    unsigned = F.when((number >= 0) & (number < limit), F.coalesce(plain, upper))
    signed_ = F.when((number >= -half) & (number < half), number.cast("long").bitwiseAND(mask(length)))
    return F.when(finite, _choose(signed, signed_, unsigned))


def label(raw: Column, length: Value, signed: Value, labels: Column) -> Column:
    """The label of a raw pattern read with its sign; patterns of 2**63 and up without sign have none."""
    key = _choose(signed, sign_extend(raw, length), F.when(raw >= 0, raw))
    return F.when(key.isNotNull(), F.try_element_at(labels, key))
