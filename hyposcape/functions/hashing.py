"""Key-derived pseudo-random draws: the same key and salt always give the same draw, on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(key: Column | str, salt: str) -> Column:
    """First 32 bits of md5(key|salt) as BIGINT."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column | str, salt: str) -> Column:
    """Uniform draw in (0, 1) from the key."""
    return (hash32(key, salt) + F.lit(0.5)) / F.lit(4294967296.0)
