"""Frozen specifications with validation (V6) and validated overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    """Declared schema: target, categorical and numeric columns (no overlap)."""

    target: str
    cats: tuple[str, ...] = ()
    nums: tuple[str, ...] = ()
    target_type: str = "string"
    row_id: str = "row_id"

    def __post_init__(self):
        overlap = set(self.cats) & set(self.nums)
        if overlap:
            raise ValueError(f"features appear in both cats and nums: {sorted(overlap)}")
        if self.target in set(self.cats) | set(self.nums):
            raise ValueError("target listed as a feature")

    @property
    def all_features(self) -> list[str]:
        return [*self.cats, *self.nums]

    def check(self, df: DataFrame, with_target: bool = True) -> None:
        """The frame carries every declared column (and the row key)."""
        need = [self.row_id, *self.all_features] + ([self.target] if with_target else [])
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise KeyError(f"columns missing from frame: {missing}")

    @staticmethod
    def infer(df: DataFrame, target: str, row_id: str = "row_id") -> "FeatureSpec":
        """Fallback typing: string -> categorical, numeric -> numeric."""
        cats = tuple(f.name for f in df.schema.fields if f.name not in (target, row_id) and f.dataType.simpleString() == "string")
        nums = tuple(f.name for f in df.schema.fields if f.name not in (target, row_id)
                     and f.dataType.simpleString() in ("float", "double", "tinyint", "smallint", "int", "bigint"))
        return FeatureSpec(target, cats, nums)


@dataclass(frozen=True)
class CVSpec:
    n_folds: int = 5
    seed: int = 1337
    shuffle: bool = True

    def __post_init__(self):
        if self.n_folds < 2:
            raise ValueError("n_folds must be >= 2")


@dataclass(frozen=True)
class DataSpec:
    train_file: str
    test_file: str
    exp_name: str
    exp_notes: str = ""

    def __post_init__(self):
        for f in (self.train_file, self.test_file):
            if not f.endswith(".parquet"):
                raise ValueError(f"expected a .parquet path, got {f!r}")


@dataclass(frozen=True)
class LearnerSpec:
    kind: str = "random_forest"
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        from tabspark.operators.cv import LEARNER_PARAMS

        if self.kind not in LEARNER_PARAMS:
            raise ValueError(f"unknown learner {self.kind!r}")
        bad = set(self.params) - LEARNER_PARAMS[self.kind]
        if bad:
            raise ValueError(f"{self.kind}: unknown parameters {sorted(bad)}")
        for k in ("subsamplingRate", "stepSize"):
            if k in self.params and not 0 < float(self.params[k]) <= 1:
                raise ValueError(f"{k} must be in (0, 1]")


def override(spec, **changes):
    """Non-None overrides over frozen defaults; the result is re-validated."""
    kept = {k: v for k, v in changes.items() if v is not None}
    if isinstance(spec, LearnerSpec) and "params" in kept:
        kept["params"] = {**spec.params, **kept["params"]}
    return dataclasses.replace(spec, **kept)  # replace() runs __post_init__ again
