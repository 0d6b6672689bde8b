"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND_DP = 6


def rounded(df: DataFrame, dp: int = ROUND_DP) -> DataFrame:
    """Presentation step of every registered query: float/double columns as double rounded to ``dp``."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("float", "double"):
            out.append(F.round(F.col(f.name).cast("double"), dp).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_round(expr: str, dp: int = ROUND_DP) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {dp})"
