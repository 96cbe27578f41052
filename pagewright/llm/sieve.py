"""A filter of fixed size that keeps most unwanted rows from moving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize

BITS = 25  # of the filter: 4 MB, whatever the number of rows
_WORD = 15  # of one of its rows


def flagged(rows: DataFrame, wanted: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with a boolean column name: true where key (longs, an expression over either table) is in wanted, and for some others.

    With far more wanted keys than 1 << BITS it is true nearly everywhere, which is right but saves nothing.
    """
    at = F.pmod(key, F.lit(1 << BITS))
    bits = wanted.select(at.alias("__at")).groupBy(F.shiftright("__at", _WORD).alias("__word")).agg(
        F.bitmap_construct_agg(F.col("__at") % (1 << _WORD)).alias("__bits")
    )
    bits = materialize(bits, "sieve")  # at most 1 << (BITS - _WORD) rows of 4 kB
    t = rows.withColumn("__at", at).join(F.broadcast(bits), F.shiftright("__at", _WORD) == F.col("__word"), "left")
    place = F.col("__at") % (1 << _WORD)
    octet = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = (F.floor(octet / F.pow(F.lit(2.0), place % 8)).cast("int") % 2) == 1
    return t.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__word", "__bits")


def kept(rows: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """rows without most of those whose key isn't in wanted; see flagged()."""
    return flagged(rows, wanted, key, "__may").filter("__may").drop("__may")
