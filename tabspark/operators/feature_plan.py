"""An ordered, configurable block plan of feature steps, fitted once on train.

Blocks run in the order A clip -> B log1p -> C ratio -> D difference -> E powers ->
F num x num -> G num x cat -> H cat x cat (+ routing) -> angle.  Each block is fitted on
the training frame *as transformed by the previous blocks* and the fitted models are
then applied lazily, in order, to any frame; every block is one projection (plus a
broadcast join for the fitted group tables), so the whole plan is one lazy DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabspark.operators.base import Model
from tabspark.operators.cross import CatCatInteract, NumCatInteract, NumNumInteract
from tabspark.operators.encode import FoldTargetEncoder, OrdinalEncoder
from tabspark.operators.transform import AngleToUnitVector, ClipIQR, Log1p, Polynomial, Ratio, Subtract


@dataclass(frozen=True)
class FeaturePlan:
    clip_cols: tuple[str, ...] = ()
    clip_factor: float = 3.0
    log_cols: tuple[str, ...] = ()
    ratio_pairs: tuple[tuple[str, str], ...] = ()
    diff_pairs: tuple[tuple[str, str], ...] = ()
    poly_cols: tuple[str, ...] = ()
    poly_degrees: tuple[int, ...] = (2,)
    num_num_pairs: tuple[tuple[str, str], ...] = ()
    num_num_top_n: int | None = None
    num_num_corr: float = 0.0
    num_cat_pairs: tuple[tuple[str, str], ...] = ()
    num_cat_stats: tuple[str, ...] = ("mean", "std")
    num_cat_min_leaf: int = 10
    cat_cat_pairs: tuple[tuple[str, str], ...] = ()
    cat_cat_max_card: int = 200
    cat_cat_low_card: int | None = None
    angle: tuple[str, str] | None = None
    angle_prefix: str = "unit_"
    exclude: tuple[str, ...] = ("row_id",)
    target: str | None = None  # with it, high-cardinality compounds get fold-aware target encodings
    classes: tuple = ()
    fold_col: str = "fold"

    def fit(self, train: DataFrame) -> "FeaturePlanModel":
        steps: list[tuple[str, Model]] = []
        cur = train

        def add(name, est):
            nonlocal cur
            model = est.fit(cur)
            steps.append((name, model))
            cur = model.transform(cur)
            return model

        if self.clip_cols:
            add("clip_iqr", ClipIQR(list(self.clip_cols), self.clip_factor, self.clip_factor))
        if self.log_cols:
            add("log1p", Log1p(list(self.log_cols)))
        if self.ratio_pairs:
            add("ratio", Ratio(list(self.ratio_pairs)))
        if self.diff_pairs:
            add("subtract", Subtract(list(self.diff_pairs)))
        if self.poly_cols:
            add("polynomial", Polynomial(list(self.poly_cols), list(self.poly_degrees)))
        if self.num_num_pairs or self.num_num_top_n:
            add("num_num", NumNumInteract(list(self.num_num_pairs) or None, self.num_num_top_n, self.num_num_corr, self.exclude))
        if self.num_cat_pairs:
            add("num_cat", NumCatInteract(list(self.num_cat_pairs), list(self.num_cat_stats), self.num_cat_min_leaf))
        high: list[str] = []
        if self.cat_cat_pairs:
            cc = add("cat_cat", CatCatInteract(list(self.cat_cat_pairs), False, self.cat_cat_max_card, self.cat_cat_low_card))
            # C9 routing: low-cardinality compounds are ordinal-encoded; high-cardinality ones get fold-aware target
            # encodings where the plan names a target (and are only listed where it does not)
            if cc.low_card_cols:
                add("ordinal_low_card", OrdinalEncoder(cc.low_card_cols))
            high = list(cc.high_card_cols)
            if self.target:
                for c in high:
                    add(f"fold_target_{c}", FoldTargetEncoder(c, self.target, list(self.classes), self.fold_col))
        if self.angle:
            add("angle", AngleToUnitVector(self.angle[0], self.angle[1], self.angle_prefix))
        return FeaturePlanModel(steps, high)


@dataclass
class FeaturePlanModel(Model):
    steps: list[tuple[str, Model]]
    high_card_cols: list[str] = field(default_factory=list)

    @property
    def stages(self) -> list[str]:
        return [n for n, _ in self.steps]

    def transform(self, df: DataFrame) -> DataFrame:
        for _, m in self.steps:
            df = m.transform(df)
        return df

    def transform_train(self, df: DataFrame) -> DataFrame:
        """The training rows: fold-aware encodings leave out the row's own fold."""
        for _, m in self.steps:
            df = m.transform_oof(df) if hasattr(m, "transform_oof") else m.transform(df)
        return df
