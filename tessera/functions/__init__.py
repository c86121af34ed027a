"""Row-level Column expressions."""

from tessera.functions.exprs import (  # noqa: F401
    EMPTY_LEVEL, LETTERS, NEG_LOG_SENTINEL, NUMERIC_FILL, PROB_EPS, STRING_FILL,
    blank_to_level, blank_to_null, char_at, clip_prob, letter_count, log1p_guarded,
    logloss_term, min_max_scale, null_count, null_to_level, row_below_zero_share,
    row_null_share, special_log, str_len, yeo_johnson,
)
from tessera.functions.hashing import (  # noqa: F401
    draw_index, draw_index_sql, mix, mix_sql, std_normal, unit_uniform,
)
