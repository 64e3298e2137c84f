from assaylake.functions.numeric import (  # noqa: F401
    fmt2, hash_unit, hashed_gauss, is_close, log10_floor, log10_ieee, log10p1,
    unlog10p1, trunc_int,
)
from assaylake.functions.text import (  # noqa: F401
    ANSWER_PAIR_REGEX, answer_names, answer_values, extension_suffix,
    largest_component, word_tokens,
)
