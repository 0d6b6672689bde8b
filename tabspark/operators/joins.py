"""Joining a fitted lookup table back onto row-level data.

Fitted tables (category statistics, dictionaries, fold statistics) are materialised
when the estimator is fitted, so their exact row count is known.  They are broadcast
only below ``BROADCAST_MAX_ROWS``; above it the plain equi-join lets Spark shuffle
(sort-merge, with AQE skew splitting of hot keys on the large side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.session import BROADCAST_MAX_ROWS


def join_fitted(
    df: DataFrame,
    fitted: DataFrame,
    on: Sequence[str] | str,
    fitted_rows: int | None,
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    if fitted_rows is not None and fitted_rows <= max_broadcast_rows:
        fitted = F.broadcast(fitted)
    return df.join(fitted, on=on, how=how)


def null_safe_key_join(
    df: DataFrame,
    fitted: DataFrame,
    key: str,
    fitted_key: str,
    fitted_rows: int | None,
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Left join where NULL keys match a NULL entry of the fitted table (``<=>``)."""
    if fitted_rows is not None and fitted_rows <= max_broadcast_rows:
        fitted = F.broadcast(fitted)
    return df.join(fitted, df[key].eqNullSafe(fitted[fitted_key]), "left").drop(fitted[fitted_key])
