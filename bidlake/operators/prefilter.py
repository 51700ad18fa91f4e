"""A filter of fixed size that keeps rows from being shuffled to a join that would drop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; 64 are a row, so at most 2^18 rows are broadcast, whatever the input.
BITS = 1 << 24


def likely_among(frame: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among ``wanted``: all that are, and of the others about the filled share of the bits.

    Null keys are left out. An exact join should follow; this only makes its input small. That must be an inner join with
    distinct keys: Spark moves a semi-join below this filter, so that all rows would be shuffled first.
    """
    bits = wanted.select((F.pmod(F.xxhash64(wanted_key), F.lit(BITS))).alias("_bit"))
    words = bits.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_mask"))
    hashed = frame.withColumn("_bit", F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(BITS)))).withColumn("_word", F.shiftright("_bit", 6))
    met = hashed.join(F.broadcast(words), "_word")  # at most BITS / 64 rows
    return met.filter("(shiftrightunsigned(_mask, cast(_bit & 63 as int)) & 1) = 1").drop("_bit", "_word", "_mask")
