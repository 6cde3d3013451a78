"""PII masks for exports.  Null stays null; ids, categories and amounts are left alone."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The recorded masks.
STARS = "***"
PHONE_STARS = "******"
PHONE_TAIL = 4
REDACTED = "[MASKED]"


def mask_name(value: Column) -> Column:
    """Each word keeps its first character: ``Ann Lee`` becomes ``A*** L***``."""
    return F.regexp_replace(value, r"(\S)\S*", f"$1{STARS}")


def mask_email(value: Column) -> Column:
    """``j.doe@mail.com`` becomes ``j***@mail.com``; what is no address is redacted."""
    address = r"(?s)^([^@])[^@]*(@[^@]+)$"
    masked = F.regexp_replace(value, address, f"$1{STARS}$2")
    return F.when(value.rlike(address), masked).otherwise(mask_redact(value))


def mask_phone(value: Column) -> Column:
    """The last digits; a number with fewer than twice as many characters is redacted."""
    masked = F.concat(F.lit(PHONE_STARS), F.right(value, F.lit(PHONE_TAIL)))
    return F.when(F.length(value) >= 2 * PHONE_TAIL, masked).otherwise(mask_redact(value))


def mask_redact(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(REDACTED))


CONTACT_POLICY: dict[str, Callable[[Column], Column]] = {
    "first_name": mask_name,
    "last_name": mask_name,
    "customer_name": mask_name,
    "full_name": mask_name,
    "merchant_name": mask_name,
    "email": mask_email,
    "phone": mask_phone,
    "date_of_birth": mask_redact,
}

# Text columns that hold ids and categories; any other text is redacted unless the policy has it.
OPEN_TEXT = frozenset(
    {
        "customer_id", "account_id", "loan_id", "transaction_id",
        "kyc_status", "loan_type", "loan_category", "loan_status", "account_type",
        "transaction_type", "channel", "status", "credit_score_flag", "principal_amount_bucket",
        "upi_inclined_flag", "category", "month", "year_month", "transaction_month",
    }
)


def _masked(name: str, value: Column, kind: T.DataType, policy, open_text) -> Column:
    if name in policy:
        return policy[name](value)
    if isinstance(kind, T.StructType):
        fields = [
            _masked(f.name, value[f.name], f.dataType, policy, open_text).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.StringType) and name not in open_text:
        return mask_redact(value)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return mask_redact(value)
    return value


def mask_table(
    df: DataFrame,
    policy: Mapping[str, Callable[[Column], Column]] = CONTACT_POLICY,
    open_text: Collection[str] = OPEN_TEXT,
) -> DataFrame:
    """Apply a column-to-mask policy in one projection, also to the fields of structs.

    Numbers, dates and the text columns in ``open_text`` pass through; any other text, and
    arrays and maps, which could hold some, are redacted.
    """
    return df.select(
        *[
            _masked(f.name, F.col(f"`{f.name}`"), f.dataType, policy, open_text).alias(f.name)
            for f in df.schema.fields
        ]
    )
