"""Closing of posting periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.controls import closing_blockers, period_requests


def close_periods(
    requests: DataFrame, periods: DataFrame, journals: DataFrame, gl: DataFrame, workflows: DataFrame
) -> DataFrame:
    """Result of each closing request with the issues found on its day.

    ``requests``: request_id, period_date, user_role, force. All requested
    periods are checked in one job.
    """
    found = closing_blockers(journals, gl, workflows).withColumnRenamed("journal_date", "period_date")
    none = F.lit(0).cast("bigint")
    issues = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("unvouchered") > 0, F.concat(F.col("unvouchered").cast("string"), F.lit(" unposted journals"))),
                F.when(
                    F.col("unapproved") > 0,
                    F.concat(F.col("unapproved").cast("string"), F.lit(" unapproved high-value transactions")),
                ),
                F.when(
                    F.col("imbalance") >= F.lit("0.01").cast("decimal(3,2)"),
                    F.concat(F.lit("Trial balance not balanced: "), F.col("imbalance").cast("string")),
                ),
            )
        ),
        "; ",
    )
    checked = (
        requests.join(found, "period_date", "left")
        .withColumn("issues", F.coalesce(issues, F.lit("")))
        .withColumn("action", F.lit("CLOSE"))
        .withColumn("blockers", F.when(F.col("issues") != "", F.lit(1).cast("bigint")).otherwise(none))
    )
    result = period_requests(checked, periods).drop("period_date", "action")
    return checked.select("request_id", "period_date", "issues").join(result, "request_id")
