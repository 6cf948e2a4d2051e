"""Portable randomness: ranks and uniforms from md5 of a key, the same in any engine and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def key(tag: str, *parts: Column | str | int) -> Column:
    """The string ``tag:part:part...``; names of columns, columns, and integers are allowed as parts."""
    cols = [F.lit(tag)]
    for p in parts:
        c = F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p
        cols.append(c.cast("string"))
    return F.concat_ws(":", *cols)


def digest(tag: str, *parts) -> Column:
    return F.md5(key(tag, *parts))


def uniform(tag: str, *parts) -> Column:
    """In [0, 1): the first 32 bits of the digest."""
    return F.conv(F.substring(digest(tag, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def integer(n: int | Column, tag: str, *parts) -> Column:
    """In 0..n-1, by the remainder of the first 32 bits."""
    return F.conv(F.substring(digest(tag, *parts), 1, 8), 16, 10).cast("bigint") % (F.lit(n) if isinstance(n, int) else n)


def pick(df, n: int, tag: str, seed: int, item: str, within: list[str] | None = None):
    """Sampling without replacement: the ``n`` items of each group that come first by digest."""
    parts = [seed, item, *(within or [])]
    order = [digest(tag, *parts), F.col(item)]
    if not within:  # TakeOrdered, no single-partition sort
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def gaussian(tag: str, *parts) -> Column:
    """A whole number close to normal: twelve 16-bit uniforms less their mean (deviation about 65536)."""
    total = F.lit(0).cast("bigint")
    for block in range(3):
        h = F.md5(F.concat(key(tag, *parts), F.lit(f":{block}")))
        for i in range(4):
            total = total + F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("bigint")
    return total - F.lit(12 * 65535 // 2)
