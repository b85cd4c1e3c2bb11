"""The 57-field line of the accounting export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_COUNT = 57

# Names of the filled positions; all other positions are empty.
FIELD_POSITIONS = {
    "journal_type": 0,
    "journal_source": 1,
    "journal_number": 2,
    "journal_line_number": 3,
    "transaction_reference": 4,
    "accounting_period": 5,
    "transaction_date": 6,
    "account_code": 7,
    "description": 8,
    "currency_code": 9,
    "transaction_amount": 10,
    "currency_rate": 11,
    "base_amount": 12,
    "d_c_marker": 13,
    "asset_indicator": 14,
    "asset_code": 15,
    "asset_sub_code": 16,
    "t1": 17,
    "t2": 18,
    "t3": 19,
    "t4": 20,
    "t5": 21,
    "t6": 22,
    "t7": 23,
    "t8": 24,
    "t9": 25,
    "t10": 26,
    "general_description_2": 28,
    "general_description_3": 29,
    "general_description_4": 30,
    "general_description_5": 31,
    "general_description_6": 32,
    "due_date": 52,
}


def fifty_seven_fields(line: Column, present: list[str]) -> Column:
    """Text array of a line struct; fields not in ``present`` are empty."""
    slots = [F.lit("")] * FIELD_COUNT
    for name, at in FIELD_POSITIONS.items():
        if name in present:
            slots[at] = F.coalesce(line[name].cast("string"), F.lit(""))
    return F.array(*slots)


def padded_fields(fields: Column) -> Column:
    """Exactly 57 fields: short arrays are padded, long ones cut."""
    return F.slice(
        F.concat(fields, F.array_repeat(F.lit(""), FIELD_COUNT)), 1, FIELD_COUNT
    )
