"""Column-expression builders (all JVM-side; no Python UDFs)."""

from churnlens.functions.coerce import is_blank, na_tokens_to_null, number
from churnlens.functions.text import basic_text, label_of_target, title_case
from churnlens.functions.bins import (
    age_group, flag_positive, risk_level, satisfaction_level, tenure_group,
)
from churnlens.functions.stats import direction_of, safe_pct
from churnlens.functions.formats import (
    fmt_amount, fmt_integer, fmt_mean, fmt_pct, fmt_prediction_pct,
)

__all__ = [
    "number", "is_blank", "na_tokens_to_null", "basic_text", "title_case",
    "label_of_target", "age_group", "tenure_group", "satisfaction_level",
    "flag_positive", "risk_level", "safe_pct", "direction_of", "fmt_integer",
    "fmt_pct", "fmt_mean", "fmt_amount", "fmt_prediction_pct",
]
