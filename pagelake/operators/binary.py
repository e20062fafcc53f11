"""Byte-level rules that column functions can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tlv_number(v: Column) -> Column:
    """A big-endian two's-complement number of one to seven bytes."""
    raw = F.conv(F.hex(v), 16, 10).cast("long")
    bits = F.octet_length(v) * 8
    sign = F.conv(F.hex(F.substring(v, 1, 1)), 16, 10).cast("int") >= 128
    return F.when(F.octet_length(v) == 0, F.lit(0)).otherwise(F.when(sign, raw - F.pow(F.lit(2), bits).cast("long")).otherwise(raw))


def xor_check(v: Column) -> Column:
    """XOR of whole little-endian 32-bit words of a binary value; what is left over does not count."""
    byte = lambda i: F.conv(F.hex(F.substr(v, i, F.lit(1))), 16, 10).cast("long")
    word = lambda i: byte(i * 4 + 1) + byte(i * 4 + 2) * 256 + byte(i * 4 + 3) * 65536 + byte(i * 4 + 4) * 16777216
    whole = F.floor(F.octet_length(v) / 4).cast("int")
    words = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), word)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def needs_expand(kind: Column, flag: Column, size: Column, stored: Column) -> Column:
    """The expanded size where stored data is compressed; else null."""
    packed = F.coalesce(flag == 1, F.lit(False)) | (F.coalesce(kind != 7, F.lit(True)) & flag.isNull() & (size > stored))
    return F.when(packed, size)


def find_first(elements: Column, tag: int) -> Column:
    """The first element of a tag, or null."""
    return F.try_element_at(F.filter(elements, lambda e: e["tag"] == tag), F.lit(1))


def utf16_trimmed(v: Column) -> Column:
    """UTF-16 with trailing NULs dropped."""
    return F.regexp_replace(F.decode(v, "UTF-16LE"), "\\x00+$", "")


def utf16_cut(v: Column) -> Column:
    """UTF-16 up to the first NUL."""
    return F.regexp_replace(F.decode(v, "UTF-16LE"), "(?s)\\x00.*$", "")


def expand_cap(stored: Column, ratio: int = 1000, most: int = 256 << 20) -> Column:
    return F.least(stored * ratio + 65536, F.lit(most))


def audit(rows: DataFrame, part: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """The first row of each part at which the running cost passes ``most``; later rows are past it too."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = rows.withColumn("used", F.sum(cost).over(w)).filter(F.col("used") > most)
    return over.groupBy(*part).agg(F.min_by(F.struct(*order, "used"), "used").alias("s")).select(*part, "s.*")


def too_many(rows: DataFrame, part: list[str], most: int) -> DataFrame:
    return rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def offsets_table(trailers: DataFrame) -> DataFrame:
    """Entries in effect, in table order, from arrays of offsets."""
    return trailers.select("file_id", F.posexplode("offsets").alias("entry_no", "at"))
