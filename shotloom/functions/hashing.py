"""Seeded, partition-independent pseudo-random numbers from md5 (exact in DuckDB too)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """u in (0, 1) from the first 32 bits of md5 over ``parts`` joined by '|'."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                             for p in parts])
    hi = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (hi + F.lit(0.5)) / F.lit(4294967296.0)


def uniform_sql(*parts: str) -> str:
    """DuckDB expression equal to :func:`uniform` for SQL expressions ``parts``."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"
