"""Export of vouchers to the accounting system."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sinks import export_lines, with_mark, write_export


class Export(NamedTuple):
    path: str
    line_count: int
    vouchers: DataFrame


def export_vouchers(
    vouchers: DataFrame,
    lines: DataFrame,
    path: str,
    start: date,
    end: date,
    journal_types: Sequence[str] | None = None,
    include_exported: bool = False,
) -> Export:
    """Write the lines and return the vouchers with those exported now marked.

    A voucher exported before keeps its date, unless ``include_exported`` writes it again.
    """
    rows = export_lines(vouchers, lines, start, end, journal_types, include_exported)
    write_export(rows, path)
    count = rows.sparkSession.read.text(path).count()
    if count == 0:
        raise ValueError("no vouchers found for export")
    done = vouchers.where(F.col("journal_date").between(F.lit(start), F.lit(end)))
    if journal_types:
        done = done.where(F.col("journal_type").isin(list(journal_types)))
    if not include_exported:
        done = done.where(~F.col("exported"))
    marked = with_mark(
        vouchers, done, "voucher_id", "exported", "export_date", F.current_timestamp().cast("timestamp_ntz")
    )
    return Export(path, count, marked)
