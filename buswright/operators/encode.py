"""Physical values to payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.functions.bits import insert_raw, insert_status
from buswright.functions.values import unscale
from buswright.sources.dbc import Message, Signal


def encode_signal(payload: Column, value: Column, signal: Signal) -> Column:
    """struct(payload, raw, status): ``payload`` with a signal set to a physical value.

    status is 'ok', 'value_out_of_range' for a value that the signal can't hold or
    'out_of_bounds' for a payload too short; then the payload is as it was.
    """
    s = signal
    raw = unscale(value, s.length, s.is_signed, s.factor, s.offset)
    status = insert_status(payload, s.start_bit, s.length, s.is_motorola, raw)
    status = F.when(raw.isNull(), "value_out_of_range").otherwise(status)
    new = F.when(raw.isNotNull(), insert_raw(payload, s.start_bit, s.length, s.is_motorola, raw)).otherwise(payload)
    return F.struct(new.alias("payload"), raw.alias("raw"), status.alias("status"))


def encode_message(rows: DataFrame, message: Message, size: int | None = None) -> DataFrame:
    """``rows`` with payload and errors: a payload of ``size`` bytes (the message's DLC) with each
    signal of the message that ``rows`` has a column for; null values leave their bits zero.

    errors are array<struct<signal, status>>.
    """
    out = rows.withColumn("payload", F.unhex(F.lit("00" * (message.dlc if size is None else size)))).withColumn("errors", F.expr("cast(array() as array<struct<signal:string,status:string>>)"))
    for s in message.signals:
        if s.name not in rows.columns:
            continue
        out = out.withColumn("__e", encode_signal(F.col("payload"), F.col(s.name).cast("double"), s))
        failed = F.col(s.name).isNotNull() & (F.col("__e.status") != "ok")
        errors = F.when(failed, F.concat("errors", F.array(F.struct(F.lit(s.name).alias("signal"), F.col("__e.status").alias("status"))))).otherwise(F.col("errors"))
        out = out.withColumn("errors", errors).withColumn("payload", F.when(F.col(s.name).isNotNull(), F.col("__e.payload")).otherwise(F.col("payload"))).drop("__e")
    return out
