"""A bounded bitmap of hashed keys: keeps rows that cannot matter out of a shuffle.

The bitmap has at most MOST_BITS bits, so its broadcast has a proven size bound (16 MB) at any input size. It can only
err by keeping a row too many; exact joins follow. Up to some 10^7 keys it keeps nearly all other rows out (bits_for
sizes it by the counted keys); beyond, it fills up, and the exact join shuffles the rows it was to keep out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
PER_ROW = 32768  # bits of one bitmap_construct_agg


def _hash(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(bucket, map): at most bits / 32768 rows of 4 KB each. Null is a key like any other."""
    h = df.select(_hash(key, bits).alias("h"))
    return h.groupBy(F.expr(f"cast(h div {PER_ROW} as int)").alias("bm_bucket")).agg(
        F.bitmap_construct_agg(F.expr(f"h % {PER_ROW}")).alias("bm_map")
    )


def bits_for(n: int) -> int:
    """Bits of a bitmap of n keys: 16 a key, a power of 2 from LEAST_BITS to MOST_BITS (16 MB)."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))


def _free(name: str, taken: list[str]) -> str:
    """name, or name with underscores in front until no column has it (whatever its case)."""
    low = {t.lower() for t in taken}
    while name in low:
        name = "_" + name
    return name


def split(df: DataFrame, key: Column, maps: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the bitmap, rows whose key is certainly not), each with df's columns as they are.

    The columns it adds on the way have names that no column of df has, so none of df's is ever written over.
    """
    names = df.columns
    back = [F.col(f"`{n}`") for n in names]
    at, bucket, found = (_free(n, names) for n in ("bm_at", "bm_bucket", "bm_map"))
    probed = df.withColumn(at, _hash(key, bits))
    probed = probed.withColumn(bucket, F.expr(f"cast({at} div {PER_ROW} as int)"))
    some = maps.select(F.col("bm_bucket").alias(bucket), F.col("bm_map").alias(found))
    probed = probed.join(F.broadcast(some), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({found}, cast({at} % {PER_ROW} as int) div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr(f"cast({at} % 8 as int)")), F.lit(0)) == 1
    return probed.where(hit).select(back), probed.where(~hit).select(back)
