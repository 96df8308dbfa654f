"""Column expressions: text cleaning, edit distance, response parsing."""

from txmetrics.functions.columns import distinct_values, q, same_key, score_columns, to_number
from txmetrics.functions.distance import cer, edit_distance, round6
from txmetrics.functions.responses import explode_lines, structured_text, vision_text
from txmetrics.functions.text import (
    clean_script,
    collapse_whitespace,
    is_blank,
    null_tokens,
    safe_name,
    stem,
    strip,
    unicode_normalise,
)

__all__ = [
    "cer",
    "clean_script",
    "collapse_whitespace",
    "distinct_values",
    "edit_distance",
    "explode_lines",
    "is_blank",
    "null_tokens",
    "q",
    "round6",
    "safe_name",
    "same_key",
    "score_columns",
    "stem",
    "strip",
    "structured_text",
    "to_number",
    "unicode_normalise",
    "vision_text",
]
