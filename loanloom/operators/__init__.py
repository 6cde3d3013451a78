from loanloom.operators.aggregates import (
    beside_rows,
    count_by,
    count_distinct,
    count_if_over,
    count_over,
    distinct_values,
    repeated_groups,
    stats,
    sum_by,
    sum_if,
    sum_if_over,
)
from loanloom.operators.distinct import count_states, distinct_states, merge_states
from loanloom.operators.joins import (
    fan_out,
    first_rows,
    keep_matching,
    lookup_or_zero,
    spine_enrich,
    sum_over_pairs,
)
from loanloom.operators.prefilter import keep_likely, key_bits
from loanloom.operators.quality import (
    assert_rows,
    check_row_count,
    counted,
    dq_profile,
    fingerprint,
)
from loanloom.operators.ranking import dedup_by, first_per_key, last_rows, latest_per_key

__all__ = [
    "assert_rows",
    "beside_rows",
    "check_row_count",
    "count_by",
    "count_distinct",
    "count_if_over",
    "count_over",
    "count_states",
    "counted",
    "dedup_by",
    "distinct_states",
    "distinct_values",
    "dq_profile",
    "fan_out",
    "fingerprint",
    "first_per_key",
    "first_rows",
    "keep_likely",
    "keep_matching",
    "key_bits",
    "last_rows",
    "latest_per_key",
    "lookup_or_zero",
    "merge_states",
    "repeated_groups",
    "spine_enrich",
    "stats",
    "sum_by",
    "sum_if",
    "sum_if_over",
    "sum_over_pairs",
]
