"""Decoded signals as text blocks and as CSV rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from buswright.functions.frames import declared_dlc, id_text, timestamp_text
from buswright.functions.values import unsigned_text
from buswright.operators.decode import decode_with, known_frames
from buswright.sources.dbc import Catalog

#: Decimals of values that are formatted without Python.
MOST_DECIMALS = 6
HEADER = "timestamp,id,message,signal,raw,value,unit,label"


def _plain(value: float, precision: int) -> str:
    """A number with at most ``precision`` decimals, exactly rounded, without trailing zeros."""
    text = f"{value:.{precision}f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return {"-0": "0", "nan": "NaN"}.get(text, text)


@F.pandas_udf(StringType())
def any_value_text(value: pd.Series, precision: pd.Series) -> pd.Series:
    """Physical values of any size at the precision that their signals can express, a batch at a time."""
    return pd.Series([_plain(v, int(p)) for v, p in zip(value, precision, strict=True)])


def value_text(value: Column, precision: Column, most: int) -> Column:
    """:func:`any_value_text` of values that :func:`_simple` allows, without Python; ``most`` is the largest precision.

    A signal's values are multiples of its last decimal but for the error of a
    double. Where that is far less than half of 10**-most, rounding to ``most``
    decimals gives the multiple, whose text ends in zeros that go.
    """
    fraction = value.cast(f"decimal({19 + most},{most})").cast("string")
    # a value of a precision of 0 is a whole number
    return F.when(precision == 0, value.cast("long").cast("string")).otherwise(F.rtrim(F.rtrim(fraction, F.lit("0")), F.lit(".")))


def csv_field(text: str) -> str:
    """A field in quotes where it holds a comma, a quote or a line end."""
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def _quoted(catalog: Catalog) -> Catalog:
    """The catalog with its names, units and labels as fields of a CSV row, so that no row has to look at them."""
    signals = lambda m: tuple(replace(s, name=csv_field(s.name), unit=csv_field(s.unit), labels={k: csv_field(v) for k, v in s.labels.items()}) for s in m.signals)
    return Catalog([replace(m, name=csv_field(m.name), signals=signals(m)) for m in catalog], catalog.name)


def _simple(most: int) -> Column:
    """Whether :func:`value_text` may take a signal's values: whole ones under 2**62, others that doubles hold to ``most`` decimals."""
    largest = F.pow(F.lit(2.0), F.col("length")) * F.abs("factor") + F.abs("offset")
    return F.when(F.col("precision") == 0, largest < float(1 << 62)).otherwise((F.col("precision") <= most) & (largest * 10.0**most < float(1 << 50)))


def _shown(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Values of all signals that fit, as text.

    How a signal's values are formatted is a column of the catalog's rows. Only
    signals whose values can't be formatted without Python are decoded in a pass
    of their own.
    """
    precisions = [s.precision for m in catalog for s in m.signals]
    most = max((p for p in precisions if p <= MOST_DECIMALS), default=0)
    signals = catalog.signals(frames.sparkSession).withColumn("simple", _simple(most))
    odd = signals.where("NOT simple")
    simple = decode_with(frames, signals.where("simple"), len(precisions), ("precision",)).where("status = 'ok'")
    simple = simple.withColumn("shown", value_text(F.col("value"), F.col("precision"), most))
    if odd.isEmpty():
        return simple
    odd = decode_with(frames, odd, len(precisions), ("precision",)).where("status = 'ok'")
    return simple.unionByName(odd.withColumn("shown", any_value_text("value", "precision")))


def csv_rows(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """seq, sig_ix and row: a CSV row for each decoded signal."""
    fields = [timestamp_text(F.col("ts_us")), id_text(F.col("can_id"), F.col("is_extended")), F.col("message"), F.col("signal"), unsigned_text(F.col("raw")), F.col("shown"), F.col("unit"), F.coalesce("label", F.lit(""))]
    return _shown(frames, _quoted(catalog)).select("seq", "sig_ix", F.concat_ws(",", *fields).alias("row"))


def text_rows(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """seq, sig_ix and row: a line for each known frame (sig_ix -1) and each of its decoded signals."""
    code = declared_dlc(F.col("payload"), F.col("len8_dlc"))
    suffix = F.when((F.length("payload") == 8) & (code > 8), F.concat(F.lit(" [dlc "), code.cast("string"), F.lit("]"))).otherwise("")
    head = F.concat(timestamp_text(F.col("ts_us")), F.lit(" "), id_text(F.col("can_id"), F.col("is_extended")), F.lit(" "), F.col("message"), suffix)
    heads = known_frames(frames, catalog).select("seq", F.lit(-1).alias("sig_ix"), head.alias("row"))
    value = F.concat(F.col("shown"), F.when(F.col("unit") == "", "").otherwise(F.concat(F.lit(" "), F.col("unit"))))
    line = F.concat(F.lit("  "), F.col("signal"), F.lit(": "), F.when(F.col("label").isNull(), value).otherwise(F.concat(F.col("label"), F.lit(" ("), value, F.lit(")"))))
    return heads.unionByName(_shown(frames, catalog).select("seq", "sig_ix", line.alias("row")))


def in_order(rows: DataFrame) -> Iterator[str]:
    """The rows of a log in its order, partition by partition, for one reader."""
    for r in rows.orderBy("seq", "sig_ix").select("row").toLocalIterator(prefetchPartitions=True):
        yield r.row


def write_csv(frames: DataFrame, catalog: Catalog, path: str) -> None:
    """CSV rows in log order as a folder of text files, without a header."""
    csv_rows(frames, catalog).orderBy("seq", "sig_ix").select("row").write.text(path)


# users' scripts read the words of this line.
def tally_text(frames: int, unknown: int, unfit: int, bad_lines: int) -> str:
    """What a run did, without the counts that are zero."""
    out = f"decoded {frames} frame(s)"
    for n, what in ((unknown, "not in the DBC"), (unfit, "signal(s) did not fit their frame"), (bad_lines, "line(s) could not be read")):
        out += f", {n} {what}" if n else ""
    return out


def read_decoded_csv(spark, path: str) -> DataFrame:
    """Rows that the CSV writer made, with a header line, as typed columns."""
    schema = "timestamp DECIMAL(20,6), id STRING, message STRING, signal STRING, raw DECIMAL(20,0), value DOUBLE, unit STRING, label STRING"
    return spark.read.csv(path, header=True, schema=schema, escape='"', emptyValue="")
