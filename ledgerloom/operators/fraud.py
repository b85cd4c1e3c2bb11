"""Fraud indicators of journals, from one aggregation per journal."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import first_digit, is_round_hundred
from ledgerloom.operators.checksums import _WORDS, _word

# Expected share of the first digits 1 to 9.
BENFORD = ["0.301", "0.176", "0.125", "0.097", "0.079", "0.067", "0.058", "0.051", "0.046"]

# Weight of each indicator in the score.
WEIGHTS = {
    "BENFORD_DEVIATION": "0.3",
    "DUPLICATE_DETECTED": "0.4",
    "EXCESSIVE_ROUND_NUMBERS": "0.2",
    "UNUSUAL_TIME_PATTERN": "0.2",
    "UNUSUAL_ACCOUNT_COMBINATION": "0.3",
    "POTENTIAL_STRUCTURING": "0.5",
}

APPROVAL_THRESHOLD = Decimal("100000")
CASH_LIMIT = Decimal("10000")
MIN_BENFORD_SAMPLE = 10
SHARE = "decimal(20,10)"


def _digit_counts() -> list[Column]:
    digit = first_digit(F.col("amount"))
    return [F.count(digit).alias("sample_size"), *[F.count_if(digit == d).alias(f"d{d}") for d in range(1, 10)]]


def _with_deviation(counted: DataFrame) -> DataFrame:
    total = F.lit(0).cast(SHARE)
    for d, expected in enumerate(BENFORD, start=1):
        actual = F.try_divide(F.col(f"d{d}").cast("decimal(18,0)"), F.col("sample_size").cast("decimal(18,0)"))
        total = total + F.abs(actual.cast(SHARE) - F.lit(expected).cast(SHARE))
    deviation = (total / F.lit(9)).cast("decimal(20,6)")
    return counted.withColumn(
        "deviation",
        F.when(F.col("sample_size") >= MIN_BENFORD_SAMPLE, deviation).otherwise(F.lit(0).cast("decimal(20,6)")),
    )


def digit_profile(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-digit counts and mean absolute deviation from the expected shares."""
    return _with_deviation(lines.groupBy(*keys).agg(*_digit_counts()))


def _line_facts() -> list[Column]:
    amount, account, dc = F.col("amount"), F.col("account_code"), F.col("dc")
    near = (amount >= F.lit(APPROVAL_THRESHOLD * Decimal("0.8"))) & (amount < F.lit(APPROVAL_THRESHOLD))
    cash_out = account.contains("CASH") & (dc == "C") & (amount > F.lit(CASH_LIMIT))
    expense = account.contains("EXPENSE") & (dc == "D")
    return [
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(is_round_hundred(amount)).alias("round_count"),
        F.count_if(near).alias("near_threshold_count"),
        (F.coalesce(F.bool_or(cash_out), F.lit(False)) & F.coalesce(F.bool_or(expense), F.lit(False))).alias(
            "unusual_combination"
        ),
    ]


def _with_shares(facts: DataFrame) -> DataFrame:
    share = (F.col("round_count").cast("decimal(18,0)") / F.col("line_count").cast("decimal(18,0)")).cast(SHARE)
    return (
        facts.withColumn("round_share", share)
        .withColumn("excessive_round", share > F.lit(Decimal("0.3")))
        .withColumn("potential_structuring", F.col("near_threshold_count") >= 3)
    )


def line_indicators(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Round-number, structuring and account-pair facts per journal."""
    return _with_shares(lines.groupBy(*keys).agg(*_line_facts()))


def _line_text() -> Column:
    return F.concat_ws(":", "account_code", F.col("amount").cast("string"), "dc")


def _signature() -> Column:
    words = [F.sum(_word(F.col("_d"), i)).cast("decimal(38,0)").cast("string") for i in range(_WORDS)]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words).alias("signature")


def signatures(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate signature: the number of lines and an order-independent digest of their texts.

    Digests are added word by word, so sums combine before the shuffle and no journal is gathered.
    """
    return lines.select(*keys, F.sha2(_line_text(), 256).alias("_d")).groupBy(*keys).agg(_signature())


def _halves(text: Column) -> list[Column]:
    """Two 64-bit hashes of a line as four numbers of 32 bits, whose sums do not overflow."""
    hashes = [F.xxhash64(F.lit(seed), text) for seed in (1, 2)]
    return [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def _quick_signature() -> Column:
    """As ``signatures``, from sums of 64-bit hashes: for matching inside one run."""
    sums = [F.sum(f"_h{i}").cast("string") for i in range(4)]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("signature")


def match_signatures(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signatures that only tell equal journals of one run: sums of two 64-bit hashes, cheaper than ``signatures``."""
    hashes = [h.alias(f"_h{i}") for i, h in enumerate(_halves(_line_text()))]
    return lines.select(*keys, *hashes).groupBy(*keys).agg(_quick_signature())


def signature_text(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same lines in readable form, sorted and joined by '|'; gathers a journal's lines in one cell."""
    return lines.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(_line_text())), "|").alias("signature_text")
    )


def duplicate_counts(journals: DataFrame, days: int = 30) -> DataFrame:
    """``journals``: journal_id, journal_date, signature.

    Other journals with the same signature dated from ``days`` before up to the
    same day: how many, and the latest one. Pairs are never formed: counts per
    (signature, day) are summed over a day range.
    """
    per_day = journals.groupBy("signature", "journal_date").agg(
        F.count(F.lit(1)).alias("_n"), F.min("journal_id").alias("_min"), F.max("journal_id").alias("_max")
    )
    day = F.unix_date("journal_date")
    w = Window.partitionBy("signature").orderBy(day)
    span = w.rangeBetween(-days, 0)
    earlier = w.rangeBetween(-days, -1)
    ranged = per_day.select(
        "signature", "journal_date", "_n", "_min", "_max",
        F.sum("_n").over(span).alias("_in_range"),
        F.last("_max").over(earlier).alias("_before"),
    )
    same_day = F.when(F.col("_max") != F.col("journal_id"), F.col("_max")).when(
        F.col("_min") != F.col("journal_id"), F.col("_min")
    )
    return (
        journals.join(ranged, ["signature", "journal_date"])
        .withColumn("duplicate_count", F.col("_in_range") - 1)
        .withColumn("has_duplicates", F.col("duplicate_count") > 0)
        .withColumn("latest_duplicate", F.coalesce(same_day, F.col("_before")))
        .drop("_n", "_min", "_max", "_in_range", "_before")
    )


def time_pattern(created: Column, day: Column) -> dict[str, Column]:
    hour = F.hour(created)
    return {
        "after_hours": (hour < 6) | (hour > 20),
        "weekend": F.weekday(created) >= 5,
        "period_end": F.dayofmonth(day) >= 28,
    }


def fraud_scores(journals: DataFrame, lines: DataFrame) -> DataFrame:
    """Score 0..1 with its indicators; review above 0.5.

    ``journals``: journal_id, journal_date, created_date. Journals without lines keep their time pattern.
    """
    hashes = [h.alias(f"_h{i}") for i, h in enumerate(_halves(_line_text()))]
    slim = lines.select("journal_id", "account_code", "amount", "dc", *hashes)
    facts = _with_shares(
        _with_deviation(slim.groupBy("journal_id").agg(*_line_facts(), *_digit_counts(), _quick_signature()))
    )
    known = journals.join(facts, "journal_id", "left")
    # Journals without lines have no signature and no duplicates; they would only form one large group.
    dup = duplicate_counts(known.where("signature IS NOT NULL").select("journal_id", "journal_date", "signature"))
    pattern = time_pattern(F.col("created_date"), F.col("journal_date"))
    unusual = pattern["after_hours"] | pattern["weekend"] | pattern["period_end"]
    joined = known.join(dup.select("journal_id", "has_duplicates"), "journal_id", "left")
    tests = {
        "BENFORD_DEVIATION": F.col("deviation") > F.lit(Decimal("0.15")),
        "DUPLICATE_DETECTED": F.col("has_duplicates"),
        "EXCESSIVE_ROUND_NUMBERS": F.col("excessive_round"),
        "UNUSUAL_TIME_PATTERN": unusual,
        "UNUSUAL_ACCOUNT_COMBINATION": F.col("unusual_combination"),
        "POTENTIAL_STRUCTURING": F.col("potential_structuring"),
    }
    score = F.lit(0).cast("decimal(4,1)")
    for name, hit in tests.items():
        score = score + F.when(hit, F.lit(WEIGHTS[name]).cast("decimal(2,1)")).otherwise(F.lit(0).cast("decimal(2,1)"))
    return joined.select(
        "journal_id",
        F.least(score.cast("decimal(4,1)"), F.lit("1.0").cast("decimal(4,1)")).alias("risk_score"),
        F.array_join(F.array_compact(F.array(*[F.when(hit, n) for n, hit in tests.items()])), ",").alias("indicators"),
    ).withColumn("requires_review", F.col("risk_score") > F.lit(Decimal("0.5")))


def account_activity_alerts(
    lines: DataFrame, as_of: Column, days: int = 30, max_count: int = 100, max_amount: int = 1_000_000
) -> DataFrame:
    """Accounts with many or large movements in the last ``days`` days."""
    recent = lines.where((F.col("journal_date") > F.date_sub(as_of, days)) & (F.col("journal_date") <= as_of))
    return (
        recent.groupBy("account_code")
        .agg(F.count(F.lit(1)).alias("movement_count"), F.sum("amount").alias("movement_amount"))
        .where((F.col("movement_count") > max_count) | (F.col("movement_amount") > max_amount))
    )
