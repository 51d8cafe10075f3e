"""Hash buckets for categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FAST_BUCKETS = 1_000_000


def md5_bucket(text: Column, buckets: int) -> Column:
    """The MD5 digest as a 128-bit number modulo ``buckets``, folded in 32-bit pieces."""
    digest = F.md5(text.cast("binary"))
    pieces = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    size = F.lit(buckets).cast("bigint")
    return reduce(lambda r, x: F.pmod(r * F.lit(1 << 32) + x, size), pieces, F.lit(0).cast("bigint"))


def feature_value(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("MISSING")))


def fast_bucket(value: Column, buckets: int = FAST_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("MISSING"))), F.lit(buckets))
