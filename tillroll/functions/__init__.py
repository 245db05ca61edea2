from tillroll.functions.columns import (  # noqa: F401
    f1,
    is_variant,
    md5_key,
    name_tokens,
    safe_ratio,
    segment,
    segment_order,
)
from tillroll.functions.prefix import ordinal, top_per_group  # noqa: F401
