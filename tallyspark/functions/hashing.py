"""Seeded hash draws that any engine with md5 reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: int | str) -> Column:
    """Uniform 32-bit draw for a key: first 8 hex digits of md5('<key>#<seed>')."""
    text = F.concat(key.cast("string"), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_pair(key: Column, seed: int | str) -> tuple[Column, Column]:
    """Two independent 28-bit draws for a key."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    first = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")
    second = F.conv(F.substring(digest, 8, 7), 16, 10).cast("bigint")
    return first, second
