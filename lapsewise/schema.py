"""Raw and staged table schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


RAW_TRANSACTIONS = _struct(
    ("msno", T.StringType(), True),
    ("payment_method_id", T.ShortType(), True),
    ("payment_plan_days", T.IntegerType(), True),
    ("plan_list_price", T.IntegerType(), True),
    ("actual_amount_paid", T.IntegerType(), True),
    ("is_auto_renew", T.ByteType(), True),
    ("transaction_date", T.IntegerType(), True),
    ("membership_expire_date", T.IntegerType(), True),
    ("is_cancel", T.ByteType(), True),
)

RAW_MEMBERS = _struct(
    ("msno", T.StringType(), True),
    ("city", T.ShortType(), True),
    ("bd", T.IntegerType(), True),
    ("gender", T.StringType(), True),
    ("registered_via", T.ShortType(), True),
    ("registration_init_time", T.IntegerType(), True),
)

STAGED_TRANSACTIONS = _struct(
    ("msno", T.StringType(), False),
    ("payment_method_id", T.ShortType(), False),
    ("plan_days", T.IntegerType(), True),
    ("list_price", T.IntegerType(), False),
    ("actual_amount_paid", T.IntegerType(), False),
    ("is_auto_renew", T.BooleanType(), False),
    ("transaction_date", T.DateType(), False),
    ("membership_expire_date", T.DateType(), True),
    ("is_cancel", T.BooleanType(), False),
    ("plan_days_imputed", T.BooleanType(), False),
)

STAGED_MEMBERS = _struct(
    ("msno", T.StringType(), False),
    ("city", T.ShortType(), False),
    ("bd", T.IntegerType(), False),
    ("gender", T.StringType(), True),
    ("registered_via", T.ShortType(), True),
    ("registration_init_time", T.DateType(), False),
)

TRANSACTION_COLUMNS = STAGED_TRANSACTIONS.fieldNames()
MEMBER_COLUMNS = STAGED_MEMBERS.fieldNames()

SPELL_COLUMNS = [
    "msno", "cohort_month", "spell_start_date", "registration_date",
    "entry_days", "tenure_days", "event", "end_date", "ended_by_cancel",
    "n_transactions", "first_plan_days", "plan_type",
    "registered_via", "city", "bd", "gender",
]
SPELL_QUARANTINE_COLUMNS = SPELL_COLUMNS[:10] + ["quarantine_reason"]
EXCLUDED_COLUMNS = [
    "msno", "cohort_month", "spell_start_date", "entry_days", "tenure_days",
    "event", "end_date", "ended_by_cancel", "n_transactions",
    "first_plan_days", "plan_type",
]
