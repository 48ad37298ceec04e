"""Schemas of the tables that pass between operators.

A bus identifier is two columns, ``can_id`` and ``is_extended``: equal numbers of
different width are different identifiers. Raw values are BIGINTs that hold the
64 bits of an unsigned pattern.
"""

FRAMES = "seq BIGINT, line_no BIGINT, ts_us BIGINT, can_id BIGINT, is_extended BOOLEAN, payload BINARY, len INT, len8_dlc INT"
LOG_ERRORS = "seq BIGINT, line_no BIGINT, message STRING"
MESSAGES = "can_id BIGINT, is_extended BOOLEAN, message STRING, dlc INT, sender STRING, n_signals INT, db STRING"
SIGNALS = (
    "can_id BIGINT, is_extended BOOLEAN, message STRING, dlc INT, sig_ix INT, signal STRING, start_bit INT, length INT, "
    "is_motorola BOOLEAN, is_signed BOOLEAN, factor DOUBLE, offset DOUBLE, minimum DOUBLE, maximum DOUBLE, unit STRING, "
    "mux_kind STRING, mux_page INT, labels MAP<BIGINT, STRING>, required INT, precision INT, has_mux BOOLEAN, "
    "mux_start INT, mux_length INT, mux_motorola BOOLEAN, mux_required INT, db STRING"
)
DECODED = (
    "seq BIGINT, ts_us BIGINT, can_id BIGINT, is_extended BOOLEAN, message STRING, sig_ix INT, signal STRING, raw BIGINT, "
    "value DOUBLE, unit STRING, label STRING, status STRING, required INT, available INT"
)
PROBLEMS = "kind STRING, message STRING, first STRING, second STRING, required INT, dlc INT, text STRING"

#: Payload bytes by data length code, fixed by CAN FD.
LENGTH_OF_DLC = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)
CLASSIC_BYTES, FD_BYTES = 8, 64
STANDARD_MAX, EXTENDED_MAX = 0x7FF, 0x1FFFFFFF
EXTENDED_FLAG, ERROR_FLAG = 1 << 31, 1 << 29
