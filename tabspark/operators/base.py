"""Estimator / model protocol shared by every fitted operator.

``Estimator.fit(train)`` runs the (small) statistics jobs and returns a ``Model`` that
holds plain values or a small materialised DataFrame; ``Model.transform(df)`` is lazy
and works on any DataFrame with the input columns (batch or streaming).
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

log = logging.getLogger("tabspark")


class Model:
    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


class Estimator:
    def fit(self, df: DataFrame) -> Model:  # pragma: no cover - interface
        raise NotImplementedError

    def fit_transform_pair(self, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fit on train, apply to both: the reference's ``(df_train, df_test)`` contract."""
        model = self.fit(train)
        return model.transform(train), model.transform(test)


class Stateless(Estimator, Model):
    """A transform with nothing to fit."""

    def fit(self, df: DataFrame) -> Model:
        return self


def present(df: DataFrame, cols: Iterable[str], op: str, on_missing: str = "skip") -> list[str]:
    """Missing-column policy (V7): skip with a warning, or raise."""
    have = set(df.columns)
    out = []
    for c in cols:
        if c in have:
            out.append(c)
        elif on_missing == "error":
            raise KeyError(f"{op}: column {c!r} not found")
        else:
            log.warning("%s: %r not in DataFrame, skipped", op, c)
    return out


def present_pairs(df: DataFrame, pairs: Sequence[Sequence[str]], op: str, on_missing: str = "skip"):
    """Ordered pairs only: a set has no order, so its output column name would vary per process."""
    have = set(df.columns)
    out = []
    for pair in pairs:
        if isinstance(pair, (set, frozenset)) or len(pair) != 2:
            raise TypeError(f"{op}: each pair must be an ordered (a, b) tuple, got {pair!r}")
        a, b = pair
        missing = [c for c in (a, b) if c not in have]
        if missing:
            if on_missing == "error":
                raise KeyError(f"{op}: columns {missing} not found")
            log.warning("%s: %s not in DataFrame, pair skipped", op, missing)
            continue
        out.append((a, b))
    return out
