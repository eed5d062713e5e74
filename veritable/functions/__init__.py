"""Column expressions shared by the operators."""

from veritable.functions.exprs import (  # noqa: F401
    GRAINS, as_day, keep_null_not, money_sum, nan_to_null, num,
    period_key, rnd, text_key, true_only,
)
