"""Vouchers consolidated from the unvouchered lines of journals.

Three groupings: ``fields`` (15 key fields, lines summed by 8 keys, a journal
belongs to the first group that touches it), ``digest`` (MD5 of four keys,
lines kept) and ``first_line`` (by source, number and period of a journal's
first line, lines consolidated by account, side, t1 and t2).
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import codes as C
from ledgerloom.operators.numbering import join_keys
from ledgerloom.scratch import cut, small_side

# The fields that make one voucher, and those of one of its lines.
GROUP_FIELDS = [
    "journal_type", "journal_source", "journal_number", "accounting_period", "transaction_date",
    "currency_code", "currency_rate", "asset_indicator", "asset_code", "asset_sub_code",
    "t1", "t3", "t4", "t5", "t7",
]
LINE_FIELDS = ["journal_line_number", "account_code", "d_c_marker", "t2", "t6", "t8", "t9", "t10"]

# Source field and rate of vouchers grouped by first line.
FIRST_LINE_SOURCE = "SUN"
FIRST_LINE_RATE = "1"

DAY_TYPE = ["setting_type", "journal_date"]


# Groups up to this number are broadcast as three numbers each, some 60 MB.
HASHED_GROUPS = 500_000


class Vouchers(NamedTuple):
    vouchers: DataFrame
    lines: DataFrame
    links: DataFrame
    orphan_lines: DataFrame


def last_sequences(existing: DataFrame) -> DataFrame:
    """Highest used sequence per type and day, from characters 12-15."""
    return existing.groupBy(F.col("journal_type").alias("setting_type"), "journal_date").agg(
        F.max(F.substring("voucher_no", 12, 4)).cast("int").alias("last_seq")
    )


def _numbered(groups: DataFrame, order: list[str], existing: DataFrame | None) -> DataFrame:
    """Sequence of each group; a day and type can hold 9999 vouchers at most."""
    w = Window.partitionBy(*DAY_TYPE).orderBy(*order)
    out = groups.withColumn("rn", F.row_number().over(w))
    if existing is None:
        out = out.withColumn("last_seq", F.lit(0))
    else:
        out = join_keys(out, last_sequences(existing), DAY_TYPE, "left")
    seq = F.col("rn") + F.coalesce("last_seq", F.lit(0))
    checked = F.when(seq <= C.MAX_VOUCHER_SEQUENCE, seq).otherwise(
        F.raise_error(F.concat(F.lit("voucher sequence above 9999 for "), "setting_type"))
    )
    return out.withColumn("seq", checked.cast("int")).drop("rn", "last_seq")


def _headers(groups: DataFrame) -> DataFrame:
    day = F.col("journal_date")
    no = C.voucher_number(F.col("setting_type"), day, F.col("seq"))
    return groups.select(
        C.stable_key(F.lit("voucher"), no).alias("voucher_id"),
        F.col("setting_type").alias("journal_type"),
        "journal_date",
        "seq",
        no.alias("voucher_no"),
        C.voucher_description(F.col("setting_description"), day, F.col("seq")).alias("description"),
    )


def _with_group(lines: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return join_keys(lines, groups.select(*keys, "seq"), keys)


def build_vouchers(
    lines: DataFrame,
    existing: DataFrame | None = None,
    grouping: str = "fields",
    split: bool = False,
) -> Vouchers:
    """Vouchers, their lines, journal links and the lines left out.

    Voucher lines carry the named fields of the export layout. ``lines``: unvouchered typed journal lines (all days in one job).
    ``split=True`` keeps a journal's lines in every group they fall into.
    """
    if grouping == "fields":
        return _by_fields(lines, existing, split)
    if grouping == "digest":
        return _by_digest(lines, existing)
    if grouping == "first_line":
        return _by_first_line(lines, existing)
    raise ValueError(f"unknown grouping {grouping}")


def _group_hash(keys: list[str]) -> Column:
    """64 bits of the key fields and of which of them are NULL."""
    missing = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)]
    return F.xxhash64(*keys, reduce(add, missing))


def _grouped(lines: DataFrame, keys: list[str], order: list[Column], existing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Numbered groups with an ``_id``, written once, and the lines with ``seq`` and ``_id`` of their group.

    Lines find their group by its hash, in place where the groups are few. Every line's group is in the table, so this
    is exact if no two groups there share a hash; if some do, lines are joined by the fields.
    """
    # Counting first aggregates by hash; a least text alone would sort all lines.
    named = lines.groupBy(*keys, "setting_description").agg(F.count(F.lit(1)).alias("_lines"))
    named = named.groupBy(*keys).agg(F.min("setting_description").alias("setting_description"), F.sum("_lines").alias("_lines"))
    groups = _numbered(named, order, existing)
    groups = groups.withColumns({"_id": F.monotonically_increasing_id(), "_hash": _group_hash(keys)})
    groups = cut(groups, "groups")
    if groups.groupBy("_hash").count().where("count > 1").isEmpty():
        found = small_side(groups.select("_hash", "seq", "_id"), HASHED_GROUPS)
        placed = lines.withColumn("_hash", _group_hash(keys)).join(found, "_hash")
    else:
        placed = join_keys(lines, groups.select(*keys, "seq", "_id"), keys)
    return groups.drop("_hash", "_lines"), placed.select(*lines.columns, "seq", "_id")


def _by_fields(lines: DataFrame, existing: DataFrame | None, split: bool) -> Vouchers:
    keys = [*DAY_TYPE, *GROUP_FIELDS]
    order = [F.col(c).cast("string") for c in GROUP_FIELDS]
    groups, placed = _grouped(lines, keys, order, existing)
    if split:
        kept, orphans = placed, lines.limit(0)
    else:
        first = placed.groupBy("journal_id").agg(F.min("seq").alias("first_seq"))
        owned = join_keys(placed, first, ["journal_id"])
        kept = owned.where(F.col("seq") == F.col("first_seq"))
        orphans = owned.where(F.col("seq") != F.col("first_seq")).drop("_id")
    # The fields of a group come back after the sums; until then a line has its group's number alone.
    summed = kept.groupBy("_id", *LINE_FIELDS).agg(
        F.sum("transaction_amount").alias("transaction_amount"), F.sum("base_amount").alias("base_amount")
    )
    headers = _headers(groups)
    heads = groups.join(
        headers.select(
            F.col("journal_type").alias("setting_type"), "journal_date", "seq", "voucher_id", "voucher_no",
            F.col("voucher_no").alias("transaction_reference"), "description",
        ),
        [*DAY_TYPE, "seq"],
    )
    out = summed.join(heads, "_id").select(
        *DAY_TYPE, "seq", *GROUP_FIELDS, *LINE_FIELDS,
        *[F.round(c, 2).cast("decimal(30,2)").alias(c) for c in ("transaction_amount", "base_amount")],
        "voucher_id", "voucher_no", "transaction_reference", "description",
    )
    links = join_keys(
        placed.groupBy("journal_id", *DAY_TYPE).agg(F.min("seq").alias("seq")),
        headers.select(F.col("journal_type").alias("setting_type"), "journal_date", "seq", "voucher_id"),
        [*DAY_TYPE, "seq"],
    )
    return Vouchers(headers, out, links, orphans)


def _by_digest(lines: DataFrame, existing: DataFrame | None) -> Vouchers:
    keyed = lines.withColumn(
        "grouping_key",
        C.group_digest(
            F.col("setting_type"), F.col("journal_source"), F.col("journal_number"), F.col("accounting_period")
        ),
    )
    keys = [*DAY_TYPE, "grouping_key"]
    groups = keyed.groupBy(*keys).agg(F.min("setting_description").alias("setting_description"))
    groups = _numbered(groups, ["grouping_key"], existing)
    placed = _with_group(keyed, groups, keys)
    headers = _headers(groups)
    out = placed.join(
        headers.select(
            F.col("journal_type").alias("setting_type"), "journal_date", "seq", "voucher_id", "voucher_no",
            F.col("description").alias("voucher_description"),
        ),
        [*DAY_TYPE, "seq"],
    )
    links = out.select("journal_id", "voucher_id", *DAY_TYPE, "seq").distinct()
    return Vouchers(headers, out, links, lines.limit(0))


def _by_first_line(lines: DataFrame, existing: DataFrame | None) -> Vouchers:
    """Groups come in the order of their first journal; ids break ties."""
    firsts = lines.groupBy("journal_id", *DAY_TYPE).agg(
        F.min_by(
            F.concat_ws("|", "journal_source", "journal_number", "accounting_period"),
            F.col("journal_line_number"),
        ).alias("grouping_key"),
        F.min("setting_description").alias("setting_description"),
    )
    keys = [*DAY_TYPE, "grouping_key"]
    groups = firsts.groupBy(*keys).agg(
        F.min("journal_id").alias("lead_journal"), F.min("setting_description").alias("setting_description")
    )
    groups = _numbered(groups, ["lead_journal"], existing)
    journal_seq = _with_group(firsts.drop("setting_description"), groups, keys).select("journal_id", "seq")
    placed = join_keys(lines, journal_seq, ["journal_id"])
    at = F.struct("journal_id", "journal_line_number")
    merged = placed.groupBy(*DAY_TYPE, "seq", "account_code", "d_c_marker", "t1", "t2").agg(
        F.sum("transaction_amount").alias("transaction_amount"),
        F.min(at).alias("first_at"),
        F.min_by(
            F.struct("description", "currency_code", *[f"t{i}" for i in range(3, 11)]), at
        ).alias("f"),
    )
    w = Window.partitionBy(*DAY_TYPE, "seq").orderBy("first_at")
    headers = _headers(groups)
    out = (
        merged.select(
            *DAY_TYPE, "seq", F.row_number().over(w).alias("journal_line_number"), "account_code", "d_c_marker",
            "t1", "t2", "f.*", "transaction_amount", F.col("transaction_amount").alias("base_amount"),
        )
        .withColumns(
            {
                "description": F.substring("description", 1, 50),
                "journal_type": F.col("setting_type"),
                "journal_source": F.lit(FIRST_LINE_SOURCE),
                "accounting_period": F.date_format("journal_date", "yyyyMM"),
                "transaction_date": F.col("journal_date").cast("string"),
                "currency_rate": F.lit(FIRST_LINE_RATE),
            }
        )
        .join(
            headers.select(
                F.col("journal_type").alias("setting_type"), "journal_date", "seq", "voucher_id", "voucher_no",
                F.col("voucher_no").alias("transaction_reference"),
            ),
            [*DAY_TYPE, "seq"],
        )
    )
    links = join_keys(
        journal_seq.join(firsts.select("journal_id", *DAY_TYPE), "journal_id"),
        headers.select(F.col("journal_type").alias("setting_type"), "journal_date", "seq", "voucher_id"),
        [*DAY_TYPE, "seq"],
    )
    return Vouchers(headers, out, links, lines.limit(0))


def link_journals(journals: DataFrame, links: DataFrame) -> DataFrame:
    """Journals with the voucher they got; one already set is kept."""
    got = links.groupBy(F.col("journal_id").alias("id")).agg(F.min("voucher_id").alias("new_voucher"))
    return (
        journals.join(got, "id", "left")
        .withColumn("voucher_id", F.coalesce("voucher_id", "new_voucher"))
        .drop("new_voucher")
    )
