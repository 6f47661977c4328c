"""Casts between pixel types as machine arithmetic has them: no errors, no NULLs of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.model.descriptor import PIXEL_TYPES, is_float


def machine_cast(value: Column, source: str, target: str) -> Column:
    """``value`` as ``target``: floats are cut off and saturate (NaN is 0), integers wrap around.  NULL stays NULL."""
    low, high, spark_type = PIXEL_TYPES[target]
    if source == target:
        return value.cast(spark_type)
    if low is None:
        return value.cast(spark_type)
    if is_float(source):
        v = value.cast("double")
        wide = "decimal(20,0)" if target in ("U64", "I64") else "bigint"
        inside = F.when(F.isnan(v), F.lit("0").cast(wide)).when(v >= float(high), F.lit(str(high)).cast(wide)).when(v <= float(low), F.lit(str(low)).cast(wide))
        cut = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
        return inside.when(v.isNotNull(), cut.cast(wide)).cast(spark_type)
    s_low, s_high, _ = PIXEL_TYPES[source]
    if low <= s_low and s_high <= high:
        return value.cast(spark_type)
    if target == "I64":  # from U64
        v = value.cast("decimal(20,0)")
        return F.when(v > 2**63 - 1, v - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(v).cast(spark_type)
    if target == "U64":  # from a signed type
        v = value.cast("decimal(20,0)")
        return F.when(v < 0, v + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(v).cast(spark_type)
    size = high - low + 1
    wide = "decimal(20,0)" if source == "U64" else "bigint"
    v = F.pmod(value.cast(wide), F.lit(size).cast(wide)).cast("bigint")
    return (F.when(v > high, v - size).otherwise(v) if low < 0 else v).cast(spark_type)


def saturated(value: Column, target: str) -> Column:
    """A wider number as ``target``, cut to its range."""
    low, high, spark_type = PIXEL_TYPES[target]
    if low is None:
        return value.cast(spark_type)
    wide = "decimal(38,0)" if target in ("U64", "I64") else "bigint"
    v = value.cast(wide)
    return F.when(v > F.lit(str(high)).cast(wide), F.lit(str(high)).cast(wide)).when(v < F.lit(str(low)).cast(wide), F.lit(str(low)).cast(wide)).otherwise(v).cast(spark_type)
