"""Money arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def line_amount(setting_amount: Column, amounts: Column, data_idx: Column) -> Column:
    """Configured amount when positive, else the rounded source element."""
    return F.when(setting_amount > 0, setting_amount.cast(MONEY)).otherwise(
        F.round(F.get(amounts, data_idx), 2).cast(MONEY)
    )


def base_amount(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate, 2).cast(MONEY)


def same_currency_sum(a: Column, cur_a: Column, b: Column, cur_b: Column) -> Column:
    """Sum of two amounts; NULL when the currencies differ."""
    return F.when(cur_a == cur_b, (a + b).cast(MONEY))


def same_currency_difference(a: Column, cur_a: Column, b: Column, cur_b: Column) -> Column:
    """Difference; NULL when the currencies differ or it would be negative."""
    return F.when((cur_a == cur_b) & (a >= b), (a - b).cast(MONEY))


def mean_of(total: Column, count: Column, scale: int = 2) -> Column:
    """Mean of ``count`` amounts with ``scale`` decimals and this total, as ``avg`` rounds it to four more; NULL for none."""
    n = F.nullif(count, F.lit(0)).cast("decimal(20,0)")
    units = (F.abs(total) * F.lit(10 ** (scale + 4)).cast(f"decimal({scale + 5},0)")).cast("decimal(38,0)")
    rest = units % n
    whole = ((units - rest) / n).cast("decimal(38,0)") + F.when(rest * 2 >= n, 1).otherwise(0)
    unit = F.lit(f"{10.0 ** -(scale + 4):.{scale + 4}f}").cast(f"decimal({scale + 4},{scale + 4})")
    return F.when(total < 0, -whole).otherwise(whole) * unit


def first_digit(amount: Column) -> Column:
    """Leading character as a digit 1-9, NULL for 0.x and negative amounts."""
    lead = F.substring(amount.cast("string"), 1, 1)
    return F.when(lead.between("1", "9"), lead.cast("int"))


def is_round_hundred(amount: Column) -> Column:
    return amount % 100 == 0


def improvement_percent(before: Column, after: Column) -> Column:
    return F.when(
        before > 0, F.round((before - after) * 100 / F.nullif(before, F.lit(0)), 2)
    ).otherwise(F.lit(0)).cast("decimal(20,2)")


def speed_up(before: Column, after: Column) -> Column:
    return F.when(after > 0, F.round(before / F.nullif(after, F.lit(0)), 2)).otherwise(
        F.lit(0)
    ).cast("decimal(20,2)")


def in_millions(amount: Column) -> Column:
    return F.round(amount / F.lit(1000000), 2).cast("decimal(24,2)")
