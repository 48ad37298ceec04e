"""Column functions of frames and their identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buswright.schemas import EXTENDED_FLAG, EXTENDED_MAX, FD_BYTES, LENGTH_OF_DLC, STANDARD_MAX


def _lengths() -> Column:
    return F.array(*[F.lit(n) for n in LENGTH_OF_DLC])


def dlc_to_len(dlc: Column) -> Column:
    """Payload bytes of a data length code; null outside 0 to 15."""
    return F.when(dlc.between(0, 15), F.element_at(_lengths(), (dlc + 1).cast("int")))


def len_to_dlc(length: Column) -> Column:
    """The data length code of a payload length; null for lengths that no code has."""
    return F.nullif(F.array_position(_lengths(), length.cast("int")), F.lit(0)).cast("int") - 1


def standard_id(raw: Column) -> Column:
    """``raw`` where it is an 11-bit identifier, else null."""
    return F.when(raw.between(0, STANDARD_MAX), raw)


def extended_id(raw: Column) -> Column:
    """``raw`` where it is a 29-bit identifier, else null."""
    return F.when(raw.between(0, EXTENDED_MAX), raw)


def dbc_id(raw: Column) -> Column:
    """struct(can_id, is_extended) of an identifier as a database writes it.

    Bit 31 marks 29-bit identifiers; the bits between are dropped. Without it the
    number must fit 11 bits, else the result is null.
    """
    raw = raw.cast("long")
    extended = raw.bitwiseAND(F.lit(EXTENDED_FLAG)) != 0
    wide = F.struct(raw.bitwiseAND(F.lit(EXTENDED_MAX)).alias("can_id"), F.lit(True).alias("is_extended"))
    narrow = F.struct(raw.alias("can_id"), F.lit(False).alias("is_extended"))
    return F.when(extended, wide).when(raw.between(0, STANDARD_MAX), narrow)


def frame_status(payload: Column, dlc: Column) -> Column:
    """What is wrong with a payload and the code declared for it (null: none): 'ok', 'too_long' or 'dlc_mismatch'.

    Codes 9 to 15 may stand on a payload of eight bytes; any other must be the
    one that its length has.
    """
    n = F.length(payload)
    agrees = dlc.isNull() | ((n == 8) & dlc.between(9, 15)) | dlc_to_len(dlc).eqNullSafe(n)
    return F.when(~agrees, "dlc_mismatch").when(n > FD_BYTES, "too_long").otherwise("ok")


def declared_dlc(payload: Column, len8_dlc: Column) -> Column:
    """A frame's data length code: the one kept beside eight bytes, or that of its length."""
    return F.coalesce(len8_dlc, len_to_dlc(F.length(payload)))


def id_text(can_id: Column, is_extended: Column) -> Column:
    """Three hex digits for a standard identifier, eight for an extended one."""
    return F.when(is_extended, F.lpad(F.hex(can_id), 8, "0")).otherwise(F.lpad(F.hex(can_id), 3, "0"))


def whole_seconds(micros: Column) -> Column:
    """Microseconds in whole seconds, exact over the range of BIGINT."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))


def timestamp_text(ts_us: Column) -> Column:
    """Seconds with six digits of microseconds."""
    micros = F.pmod(ts_us, F.lit(1_000_000))
    return F.concat(whole_seconds(ts_us).cast("string"), F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
