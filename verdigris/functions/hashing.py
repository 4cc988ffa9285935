"""Stable hashes as positions in the unit interval, percent partitions and orders.

Parts are joined by NUL; the first hex digits of the digest are read as an integer, which fits a long.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUL = "\0"


def _joined(parts) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws(NUL, *cols)


def hex_prefix(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def unit(*parts: Column | str, digits: int = 12) -> Column:
    """SHA-256 of the parts as a double in [0, 1), from 12 or 15 hex digits. String parts are literals."""
    return hex_prefix(F.sha2(_joined(parts), 256), digits) / F.lit(float(16**digits))


def percent(*parts: Column | str) -> Column:
    """0 to 99 from the first eight hex digits of SHA-256."""
    return F.pmod(hex_prefix(F.sha2(_joined(parts), 256), 8), F.lit(100)).cast("int")


def sha1_share(*parts: Column | str) -> Column:
    """SHA-1's first eight hex digits over 0xFFFFFFFF; the parts are joined without a separator."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return hex_prefix(F.sha1(F.concat(*cols).cast("binary")), 8) / F.lit(float(0xFFFFFFFF))


def stable_order(*parts: Column | str) -> Column:
    return F.sha2(_joined(parts), 256)


def cumulative_split(position: Column, shares: list[tuple[str, float]]) -> Column:
    """The name of the share in whose part of [0, 1) the position lies; the last takes the rest."""
    out, upper = None, 0.0
    for name, share in shares[:-1]:
        upper += share
        out = F.when(position < upper, name) if out is None else out.when(position < upper, name)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def dev_test_train(bucket: Column) -> Column:
    return F.when(bucket < 5, "dev").when(bucket < 15, "test").otherwise("train")
