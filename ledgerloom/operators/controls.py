"""Approval, period and segregation-of-duties controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper amount of approval levels 0, 1 and 2; approvers per level.
LEVEL_LIMITS = [100_000, 1_000_000, 10_000_000]
APPROVERS = {1: [2, 3], 2: [4, 5], 3: [6]}

# Who may do what.
DUTIES = {
    "CLERK": ["CREATE"],
    "SUPERVISOR": ["CREATE", "APPROVE", "REVERSE"],
    "MANAGER": ["CREATE", "APPROVE", "POST", "REVERSE", "EXPORT"],
    "AUDITOR": ["EXPORT"],
}
OPENING_ROLES = ["MANAGER", "ADMIN"]
CLOSING_ROLES = ["MANAGER", "CFO", "ADMIN"]


def approval_level(amount: Column) -> Column:
    a, b, c = LEVEL_LIMITS
    return F.when(amount <= a, 0).when(amount <= b, 1).when(amount <= c, 2).otherwise(3)


def approvers(level: Column) -> Column:
    out = F.array().cast("array<int>")
    for n, ids in APPROVERS.items():
        out = F.when(level == n, F.array(*[F.lit(i) for i in ids])).otherwise(out)
    return out


def submit_for_approval(journals: DataFrame) -> DataFrame:
    """``journals``: journal_id, amount, submitted_by, urgency."""
    level = approval_level(F.col("amount"))
    return (
        journals.withColumn("approval_level", level)
        .withColumn("approvers", approvers(F.col("approval_level")))
        .withColumn("status", F.when(F.col("approval_level") == 0, "AUTO_APPROVED").otherwise("PENDING"))
        .withColumn(
            "sla_hours",
            F.when(F.col("approval_level") == 0, F.lit(None).cast("int"))
            .when(F.col("urgency") == "URGENT", 24)
            .otherwise(72),
        )
    )


def approve(requests: DataFrame, workflows: DataFrame) -> DataFrame:
    """Result of each approval request against its workflow.

    ``requests``: journal_id, user_id. ``workflows``: journal_id, status,
    approvers, submitted_by. A refused request names the first broken rule.
    """
    joined = requests.join(
        workflows.select("journal_id", F.col("status").alias("workflow_status"), "approvers", "submitted_by"),
        "journal_id",
        "left",
    )
    reason = (
        F.when(F.col("workflow_status").isNull(), "NO_WORKFLOW")
        .when(F.col("workflow_status") != "PENDING", "NOT_PENDING")
        .when(~F.array_contains("approvers", F.col("user_id").cast("int")), "NOT_AN_APPROVER")
        .when(F.col("user_id") == F.col("submitted_by"), "OWN_SUBMISSION")
    )
    return joined.select(
        "journal_id",
        "user_id",
        F.when(reason.isNull(), "APPROVED").otherwise("REFUSED").alias("result"),
        reason.alias("reason"),
    )


def period_requests(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Open and close requests against the period table.

    ``requests``: request_id, period_date, action, user_role, and blockers
    (number of open issues) with force for closing.
    """
    joined = requests.join(periods.select("period_date", F.col("status").alias("period_status")), "period_date", "left")
    opening, closing = F.col("action") == "OPEN", F.col("action") == "CLOSE"
    status = F.col("period_status")
    reason = (
        F.when(opening & ~F.col("user_role").isin(OPENING_ROLES), "UNAUTHORIZED")
        .when(closing & ~F.col("user_role").isin(CLOSING_ROLES), "UNAUTHORIZED")
        .when(opening & status.isNotNull() & (status != "CLOSED"), F.concat(F.lit("ALREADY_"), status))
        .when(closing & F.coalesce(status != "OPEN", F.lit(True)), "NOT_OPEN")
        .when(closing & (F.col("blockers") > 0) & ~F.col("force"), "BLOCKED")
    )
    new = F.when(reason.isNull(), F.when(opening, "OPEN").otherwise("CLOSED")).otherwise(status)
    return joined.select("request_id", "period_date", "action", reason.alias("reason"), new.alias("new_status"))


def posting_allowed(entries: DataFrame, periods: DataFrame, day: str) -> DataFrame:
    """Adds ``in_open_period`` from the month's period row."""
    months = periods.select(
        F.trunc("period_date", "MM").cast("date").alias("_month"), (F.col("status") == "OPEN").alias("_open")
    ).groupBy("_month").agg(F.bool_or("_open").alias("_open"))
    return (
        entries.withColumn("_m", F.trunc(day, "MM").cast("date"))
        .join(months, F.col("_m") == F.col("_month"), "left")
        .withColumn("in_open_period", F.coalesce("_open", F.lit(False)))
        .drop("_m", "_month", "_open")
    )


def open_by_month_distance(day: Column, today: Column) -> Column:
    """Same year and at most one month back (later months pass, too)."""
    return (F.year(day) == F.year(today)) & (F.month(today) - F.month(day) <= 1)


def duty_allowed(role: Column, action: Column) -> Column:
    ok = F.lit(False)
    for name, actions in DUTIES.items():
        ok = ok | ((role == name) & action.isin(actions))
    return ok


def duty_violations(actions: DataFrame) -> DataFrame:
    """Rows of (user_role, action, ...) outside the matrix."""
    return actions.where(~F.coalesce(duty_allowed(F.col("user_role"), F.col("action")), F.lit(False)))


def closing_blockers(journals: DataFrame, gl: DataFrame, workflows: DataFrame) -> DataFrame:
    """Per day: unvouchered journals, unapproved high-value journals, balance.

    ``workflows``: journal_date, status, approval_level.
    """
    zero = F.lit(0).cast("decimal(30,2)")
    open_journals = journals.groupBy("journal_date").agg(
        F.count_if(F.col("voucher_id").isNull()).alias("unvouchered")
    )
    waiting = workflows.groupBy("journal_date").agg(
        F.count_if((F.col("status") == "PENDING") & (F.col("approval_level") > 0)).alias("unapproved")
    )
    balance = gl.groupBy(F.col("trx_date").alias("journal_date")).agg(
        (
            F.coalesce(F.sum(F.when(F.col("acc_debit").isNotNull(), F.col("amount"))), zero)
            - F.coalesce(F.sum(F.when(F.col("acc_credit").isNotNull(), F.col("amount"))), zero)
        )
        .cast("decimal(31,2)")
        .alias("difference")
    )
    out = open_journals.join(waiting, "journal_date", "left").join(balance, "journal_date", "left")
    gap = F.abs(F.coalesce("difference", F.lit(0).cast("decimal(31,2)")))
    return out.select(
        "journal_date",
        "unvouchered",
        F.coalesce("unapproved", F.lit(0).cast("bigint")).alias("unapproved"),
        gap.alias("imbalance"),
    ).withColumn(
        "can_close",
        (F.col("unvouchered") == 0) & (F.col("unapproved") == 0) & (F.col("imbalance") < F.lit("0.01").cast("decimal(3,2)")),
    )
