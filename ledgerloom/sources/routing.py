"""Which source serves a datasource id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import DATASOURCE_ROW, conform

# Id ranges per source in the order they are tested. Ids 91-92
# go to the unit deals before the wider 91-99 range; 81-90 and 181-190 have no
# source.
SOURCE_RANGES = [
    ("underwriting", [(1, 10), (101, 110)]),
    ("bank_reconciliation", [(11, 30), (111, 130)]),
    ("bank_reconciliation_ul", [(51, 70), (151, 170)]),
    ("unit_deal_ul", [(91, 92), (191, 192)]),
    ("claim_process", [(31, 40), (131, 140)]),
    ("claim_process_ul", [(71, 80), (171, 180)]),
    ("claim_payment", [(41, 50), (141, 150)]),
    (None, [(81, 90), (181, 190)]),
    ("appropriate", [(91, 99)]),
]


def source_name(ds: Column) -> Column:
    """Source of a datasource id, NULL when none serves it."""
    out = F.lit(None).cast("string")
    for name, ranges in reversed(SOURCE_RANGES):
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | ds.between(low, high)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def read_sources(frames: dict[str, DataFrame], ids: list[int], extra: str = "") -> DataFrame:
    """Union of the named source frames for the given datasource ids.

    Each frame carries ``ds``; rows whose id routes to another source are not
    taken from it.
    """
    schema = DATASOURCE_ROW + ", ds int" + (f", {extra}" if extra else "")
    parts = [
        conform(df.where(source_name(F.col("ds")) == name), schema).where(F.col("ds").isin(ids))
        for name, df in frames.items()
    ]
    if not parts:
        raise ValueError("no source frames given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
