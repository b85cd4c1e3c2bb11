"""Text cleaning and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields masked to their last characters, and fields removed.
SENSITIVE_FIELDS = ["account_number", "policy_holder_id", "ssn", "tax_id"]
PII_FIELDS = ["name", "email", "phone", "address"]


def clean_reference(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("."), F.lit("")), 1, 15)


def clean_participant(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("."), F.lit("")), 1, 30)


def clean_description(text: Column) -> Column:
    """First 50 characters, each run of NUL, LF and CR turned into one space."""
    return F.regexp_replace(F.substring(text, 1, 50), r"[\x00\n\r]+", " ")


def masked(text: Column, keep: int = 4) -> Column:
    """Stars in place of all but the last ``keep`` characters; short text is only stars."""
    size = F.length(text)
    return F.when(size <= keep, F.lit("*" * keep)).otherwise(
        F.concat(F.repeat(F.lit("*"), size - keep), F.right(text, F.lit(keep)))
    )


def masked_values(values: Column, sensitive: list[str], keep: int = 4) -> Column:
    """Mask the named keys of a string map."""
    return F.transform_values(
        values, lambda k, v: F.when(k.isin(sensitive), masked(v, keep)).otherwise(v)
    )


def without_keys(values: Column, dropped: list[str]) -> Column:
    return F.map_filter(values, lambda k, _: ~k.isin(dropped))
