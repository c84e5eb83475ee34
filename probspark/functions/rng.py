"""Counter-based uniforms: the same key gives the same number on any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """U[0, 1) from the MD5 of seed and keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int | str, *keys: str) -> str:
    """The same number as a DuckDB expression."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8) AS UBIGINT) / 4294967296.0)"
