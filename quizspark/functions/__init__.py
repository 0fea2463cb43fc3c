"""Column-expression helpers (all JVM-side built-ins)."""

from quizspark.functions.arrays import (
    letter_index, option_value, p_correct, nan_to_null, nan_to_zero, correct_flag,
    log_softmax, argmax_letter, top_k_letters, sorted_desc, exp_safe,
)
from quizspark.functions.text import word_count, as_percent, format_stat

__all__ = [
    "letter_index", "option_value", "p_correct", "nan_to_null", "nan_to_zero", "correct_flag",
    "log_softmax", "argmax_letter", "top_k_letters", "sorted_desc", "exp_safe",
    "word_count", "as_percent", "format_stat",
]
