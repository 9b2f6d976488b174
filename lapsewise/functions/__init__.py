from lapsewise.functions.columns import (
    cohort_month,
    days_between,
    exclude_value,
    null_sentinel,
    plan_type,
    ratio,
    yyyymmdd_to_date,
)
from lapsewise.functions.packing import pack_day_pair, unpack_flag, unpack_second_day

__all__ = [
    "cohort_month", "days_between", "exclude_value", "null_sentinel",
    "pack_day_pair", "plan_type", "ratio", "unpack_flag", "unpack_second_day",
    "yyyymmdd_to_date",
]
