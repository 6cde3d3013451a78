from loanloom.functions.bands import (
    activity_flag,
    credit_band,
    principal_bucket,
    volume_category,
)
from loanloom.functions.calendar import days_before, month_date, month_key, month_start
from loanloom.functions.masking import (
    mask_email,
    mask_name,
    mask_phone,
    mask_redact,
    mask_table,
)
from loanloom.functions.text import (
    canonical_category,
    category_is,
    full_name,
    labelled_line,
    money,
    raw_spellings,
    spelled_like,
)

__all__ = [
    "activity_flag",
    "canonical_category",
    "category_is",
    "credit_band",
    "days_before",
    "full_name",
    "labelled_line",
    "mask_email",
    "mask_name",
    "mask_phone",
    "mask_redact",
    "mask_table",
    "money",
    "month_date",
    "month_key",
    "month_start",
    "principal_bucket",
    "raw_spellings",
    "spelled_like",
    "volume_category",
]
