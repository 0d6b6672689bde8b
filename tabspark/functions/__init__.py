"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from tabspark.functions.exprs import (  # noqa: F401
    argmax_index,
    as_float,
    bias_corrected_kurtosis,
    bias_corrected_skewness,
    fold_order_key,
    left_closed_bin,
    renorm_array,
    safe_log1p,
    safe_ratio,
)
