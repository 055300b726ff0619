"""Quantisation of values in a long table (group, position, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bound

#: The sixteen levels of the 4-bit normal-float code (fixed values).
NF4 = (-1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0, 0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0)


def nearest_level(x: Column) -> Column:
    """Index of the nearest level, the lower of two as near."""
    gaps = F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(NF4)])
    return F.array_min(gaps)["k"]


def quantize_4bit(df: DataFrame, by: str, at: str, value: str, block: int = 64) -> DataFrame:
    """(by, block_no, at, code, scale, restored): blocks scaled by their largest magnitude."""
    numbered = df.withColumn("block_no", F.floor(F.col(at) / block))
    scales = numbered.groupBy(by, "block_no").agg(F.max(F.abs(F.col(value))).alias("scale"))
    joined = numbered.join(scales, [by, "block_no"])
    unit = F.when(F.col("scale") == 0, 0.0).otherwise(F.col(value) / F.col("scale"))
    coded = joined.withColumn("code", nearest_level(unit))
    return coded.withColumn("restored", F.element_at(F.array(*[F.lit(v) for v in NF4]), F.col("code") + 1) * F.col("scale"))


def pack_4bit(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 4).bitwiseOR(low)


def unpack_4bit(byte: Column) -> tuple[Column, Column]:
    return F.shiftright(byte, 4), byte.bitwiseAND(15)


def fp8(x: Column) -> Column:
    """The nearest value with a 4-bit exponent and a 3-bit mantissa: at most 448, zero below 2 ** -9, ties to even."""

    def nearest(m: Column) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(m, F.lit(2.0**-20)))), F.lit(-6)).cast("double") - 3)
        return F.when(m < 2.0**-9, 0.0).otherwise(bound(step, lambda s: F.least(F.rint(m / s) * s, F.lit(448.0))))

    return F.signum(x) * bound(F.abs(x), nearest)


def fp8_byte(x: Column) -> Column:
    """The byte of :func:`fp8`: a sign, four bits of exponent (biased by 7) and three of mantissa; NaN and null values are 127."""

    def byte(m: Column) -> Column:
        exponent = F.greatest(F.floor(F.log2(F.greatest(m, F.lit(2.0**-20)))), F.lit(-6)).cast("int")
        return F.when(m >= 2.0**-6, (exponent + 7) * 8 + (m / F.pow(F.lit(2.0), exponent.cast("double")) * 8 - 8).cast("int")).otherwise((m * 512).cast("int"))

    size = bound(F.abs(fp8(F.nanvl(x, F.lit(0.0)))), byte)
    return F.when(x.isNull() | F.isnan(x), 127).otherwise(F.when(x < 0, 128).otherwise(0) + size).cast("int")


def fp8_value(byte: Column) -> Column:
    """The value of a byte of :func:`fp8_byte`; NaN for 127 and 255."""

    def value(b: Column) -> Column:
        exponent, mantissa = F.shiftright(b, 3).bitwiseAND(15), b.bitwiseAND(7)
        size = F.when(exponent == 0, mantissa / 8.0 * 2.0**-6).otherwise((1 + mantissa / 8.0) * F.pow(F.lit(2.0), (exponent - 7).cast("double")))
        return F.when(b.bitwiseAND(127) == 127, float("nan")).otherwise(F.when(b >= 128, -size).otherwise(size))

    return bound(byte, value)


def packed_blocks_4bit(df: DataFrame, by: str, at: str, value: str, block: int = 64) -> DataFrame:
    """(by, block_no, n, packed, scale_byte): blocks of ``block`` values as two codes a byte, the first one high, and the scale as a byte of :func:`fp8_byte`.

    Positions count from 0 without gaps; an odd last code has a zero beside it.
    """
    coded = quantize_4bit(df, by, at, value, block)
    rows = coded.groupBy(by, "block_no").agg(F.first("scale").alias("scale"), F.transform(F.array_sort(F.collect_list(F.struct(at, "code"))), lambda s: s["code"]).alias("codes"))
    pair = lambda k: pack_4bit(F.element_at("codes", (2 * k + 1).cast("int")), F.coalesce(F.try_element_at("codes", (2 * k + 2).cast("int")), F.lit(0)))
    hexadecimal = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size("codes") / 2).cast("int") - 1), lambda k: F.lpad(F.hex(pair(k)), 2, "0")), "")
    return rows.select(by, "block_no", F.size("codes").alias("n"), F.unhex(hexadecimal).alias("packed"), fp8_byte(F.col("scale")).alias("scale_byte"))


def unpacked_blocks_4bit(packed: DataFrame, by: str, at: str = "at", block: int = 64) -> DataFrame:
    """(by, at, restored) of :func:`packed_blocks_4bit`'s rows."""
    byte = F.conv(F.hex(F.substring("packed", F.col("k") / 2 + 1, F.lit(1))), 16, 10).cast("int")
    high, low = unpack_4bit(byte)
    each = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("code", F.when(F.col("k") % 2 == 0, high).otherwise(low))
    level = F.element_at(F.array(*[F.lit(v) for v in NF4]), F.col("code") + 1)
    return each.select(by, (F.col("block_no") * block + F.col("k")).alias(at), (level * fp8_value(F.col("scale_byte"))).alias("restored"))


def rounded_to_step(x: Column, step: float) -> Column:
    """Half-even rounding to multiples of a step."""
    return F.rint(x / step) * step
