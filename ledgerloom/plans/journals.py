"""Journals, journal lines and ledger rows from settings and source rows.

Everything about one source row is computed inside the row: its configured
lines are an array taken from the (small) settings, transformed and folded
with array functions. No shuffle is needed and no key can be hot.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import codes as C
from ledgerloom.functions import text as X
from ledgerloom.schemas import LINE_CONFIG
from ledgerloom.scratch import small_side

START_OF_JOURNALS = date(2019, 5, 1)

def setting_active(day: Column, mode: str = "either") -> Column:
    """Whether a setting (status, status2, journal_set) applies on ``day``.

    either: one missing bound is enough. strict: both must be missing.
    domain: as strict, and an expired setting goes on only without a start.
    """
    start, end = F.col("journal_set.start_period"), F.col("journal_set.end_period")
    inside = start.isNotNull() & end.isNotNull() & day.between(start, end)
    extended = end.isNotNull() & (F.coalesce(F.col("status2"), F.lit(0)) == 1) & (day > end)
    if mode == "either":
        free = start.isNull() | end.isNull()
    elif mode == "strict":
        free = start.isNull() & end.isNull()
    elif mode == "domain":
        free = start.isNull() & end.isNull()
        extended = extended & start.isNull()
    else:
        raise ValueError(f"unknown mode {mode}")
    active = free | F.coalesce(inside, F.lit(False)) | F.coalesce(extended, F.lit(False))
    return (F.col("status") == 1) & active


def active_settings(
    settings: DataFrame, day: date, mode: str = "either", types: list[str] | None = None
) -> DataFrame:
    picked = settings.where(setting_active(F.lit(day), mode))
    return picked.where(F.col("journal_type").isin(types)) if types else picked


def gate_status(day: Column, start: date = START_OF_JOURNALS) -> Column:
    """0 where journals may be built, 1 before the first journal day."""
    return F.when(day >= F.lit(start), 0).otherwise(1)


# A configured line as it is used: where it stands in process order, whether
# its account is looked up, and which later lines (with a positive amount)
# would overwrite its journal line number.
POSITIONED = (
    LINE_CONFIG[:-1] + ",pos:int,by_lookup:boolean,later:array<struct<data_idx:int,amount:decimal(20,2)>>>"
)

_LINE_CONFIG_FIELDS = [
    "journal_line_number", "process_line_number", "account_code", "d_c_marker", "data_idx",
    "account_flag", "transaction_amount", *[f"t{i}_code" for i in range(1, 11)],
]


def in_process_order(rows: Column) -> Column:
    """By process line, then journal line (missing ones last), with positions."""

    def key(x: Column) -> Column:
        p, n = x["process_line_number"], x["journal_line_number"]
        return F.struct(
            p.isNull().alias("a"), F.coalesce(p, F.lit(0)).alias("b"),
            n.isNull().alias("c"), F.coalesce(n, F.lit(0)).alias("d"),
        )

    ordered = F.array_sort(
        rows, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)
    )
    numbered = F.transform(ordered, lambda x, i: F.struct(i.alias("pos"), x.alias("row")))

    def positioned(x: Column) -> Column:
        row = x["row"]
        later = F.filter(
            numbered,
            lambda y: (y["pos"] > x["pos"])
            & (y["row"]["journal_line_number"] == row["journal_line_number"]),
        )
        return F.struct(
            *[row[f].alias(f) for f in _LINE_CONFIG_FIELDS],
            x["pos"].alias("pos"),
            C.is_lookup_account(row["account_code"]).alias("by_lookup"),
            F.transform(
                later,
                lambda y: F.struct(
                    y["row"]["data_idx"].alias("data_idx"),
                    y["row"]["transaction_amount"].alias("amount"),
                ),
            ).alias("later"),
        )

    return F.transform(numbered, positioned).cast(f"array<{POSITIONED}>")


def reversal_rows(lines: Column, config: Column) -> Column:
    """Line configuration of a reversal from the original journal's lines."""
    none = F.array(F.lit(None).cast(LINE_CONFIG))

    def one(line: Column, cfg: Column) -> Column:
        number = line["journal_line_number"].cast("int")
        return F.struct(
            number.alias("journal_line_number"),
            cfg["process_line_number"].alias("process_line_number"),
            line["account_code"].alias("account_code"),
            C.opposite_side(line["d_c_marker"]).alias("d_c_marker"),
            (number - 1).alias("data_idx"),
            cfg["account_flag"].alias("account_flag"),
            line["transaction_amount"].cast("decimal(20,2)").alias("transaction_amount"),
            *[line[f"t{i}"].alias(f"t{i}_code") for i in range(1, 11)],
        )

    def matching(line: Column) -> Column:
        hits = F.filter(
            config, lambda c: c["journal_line_number"] == line["journal_line_number"].cast("int")
        )
        return F.transform(F.when(F.size(hits) > 0, hits).otherwise(none), lambda cfg: one(line, cfg))

    return F.flatten(F.transform(lines, matching))


def _amount(cfg: Column) -> Column:
    return A.line_amount(cfg["transaction_amount"], F.col("transaction_amount"), cfg["data_idx"])


def _account(cfg: Column) -> Column:
    return F.when(cfg["by_lookup"], F.get("account_code", cfg["data_idx"])).otherwise(cfg["account_code"])


def _gl_fold(config: Column) -> Column:
    """Posting lines of the account-flag machine with the accounts and the
    amount carried to them."""
    item = f"struct<cfg:{POSITIONED},debit:string,credit:string,amount:decimal(20,2)>"
    start = F.struct(
        F.lit("").alias("d"),
        F.lit("").alias("c"),
        F.lit(0).cast("decimal(20,2)").alias("x"),
        F.array().cast(f"array<{item}>").alias("rows"),
    )

    def step(acc: Column, cfg: Column) -> Column:
        flag, amount = cfg["account_flag"], _amount(cfg)
        d = F.when(cfg["d_c_marker"] == "D", _account(cfg)).otherwise(acc["d"])
        c = F.when(cfg["d_c_marker"] == "C", _account(cfg)).otherwise(acc["c"])
        posted = F.when(flag == 1, amount).otherwise(acc["x"])
        x = (
            F.when(flag.isin(1, 2), amount)
            .when(flag == 4, (amount - acc["x"]).cast("decimal(20,2)"))
            .otherwise(acc["x"])
        )
        row = F.struct(
            cfg.alias("cfg"), d.alias("debit"), c.alias("credit"), posted.alias("amount")
        ).cast(item)
        rows = F.when(flag.isin(1, 3, 4), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"])
        after = F.struct(d.alias("d"), c.alias("c"), x.alias("x"), rows.alias("rows"))
        return F.when(amount > 0, after).otherwise(acc)

    return F.aggregate(config, start, step)["rows"]


def _tcodes(cfg: Column) -> list[Column]:
    return [
        C.tcode(cfg[f"t{i}_code"], F.col(f"t{i}"), cfg["data_idx"] if i >= 8 else None).alias(f"t{i}")
        for i in range(1, 11)
    ]


# Every field a journal line is concatenated from; one NULL drops the line.
_HEAD_FIELDS = [
    "src_journal_type", "journal_source", "journal_number", "clean_reference", "accounting_period",
    "transaction_date", "clean_text", "currency_code", "currency_rate", "asset_indicator", "asset_code",
    "asset_sub_code", "general_description_2", "clean_participant", "general_description_4",
    "general_description_5", "general_description_6", "due_date",
]


class Built(NamedTuple):
    journals: DataFrame
    lines: DataFrame
    gl: DataFrame
    dropped_lines: DataFrame


def source_rows(
    settings: DataFrame,
    sources: DataFrame,
    originals: DataFrame | None = None,
    mode: str = "either",
    start: date = START_OF_JOURNALS,
) -> DataFrame:
    """One row per journal with its positioned line configuration ``config``.

    ``sources``: the datasource contract plus ``ds`` and ``journal_date``.
    ``originals``: (id, lines) of the journals that reversal types refer to.
    All days present in ``sources`` are built in one job.
    """
    plain = settings.where(F.col("status") == 1)
    conf = plain.select(
        F.col("journal_type").alias("setting_type"),
        F.col("description").alias("setting_description"),
        "status",
        "status2",
        "journal_set",
        C.is_reversal(F.col("journal_type")).alias("reversal"),
        in_process_order(F.col("journal_set.row")).alias("ordered"),
    )
    # Settings are configuration: broadcast once counted, so source rows stay in place.
    conf = small_side(conf)
    src = sources.where(gate_status(F.col("journal_date"), start) == 0).withColumnRenamed(
        "journal_type", "src_journal_type"
    )
    head_complete = F.lit(True)
    for f in _HEAD_FIELDS:
        head_complete = head_complete & F.col(f).isNotNull()
    src = (
        src.withColumn("clean_reference", X.clean_reference(F.col("transaction_reference")))
        .withColumn("clean_text", X.clean_description(F.col("description")))
        .withColumn("clean_participant", X.clean_participant(F.col("general_description_3")))
        .withColumn("head_complete", head_complete)
    )
    joined = src.join(
        conf, (F.col("ds") == F.col("journal_set.ds")) & setting_active(F.col("journal_date"), mode)
    )
    config = F.when(F.coalesce("reversal", F.lit(True)), F.array().cast(f"array<{POSITIONED}>")).otherwise(
        F.col("ordered")
    )
    if originals is not None:
        prior = originals.select(F.col("id").alias("original_id"), F.col("lines").alias("original_lines"))
        joined = joined.join(prior, F.col("id") == F.col("original_id"), "left")
        back = reversal_rows(
            F.coalesce("original_lines", F.array()), F.col("journal_set.row")
        )
        config = F.when(F.col("reversal"), in_process_order(back)).otherwise(config)
    return (
        joined.withColumn("config", config)
        .withColumn("max_line", F.size("journal_set.row"))
        .withColumn(
            "journal_id", C.stable_key(F.col("setting_type"), F.col("id"), F.col("journal_date"))
        )
        .drop("ordered", "journal_set")
    )


# Head columns of a journal line: name while building -> name in the result.
_LINE_HEAD = {
    "src_journal_type": "journal_type", "journal_source": "journal_source",
    "journal_number": "journal_number", "clean_reference": "transaction_reference",
    "accounting_period": "accounting_period", "transaction_date": "transaction_date",
    "clean_text": "description", "currency_code": "currency_code", "currency_rate": "currency_rate",
    "asset_indicator": "asset_indicator", "asset_code": "asset_code", "asset_sub_code": "asset_sub_code",
    "general_description_2": "general_description_2", "clean_participant": "general_description_3",
    "general_description_4": "general_description_4", "general_description_5": "general_description_5",
    "general_description_6": "general_description_6", "due_date": "due_date",
}


def _lines(rows: DataFrame) -> DataFrame:
    """Surviving line slots with ``complete`` (no NULL in any field).

    Only the configured line is exploded; its values are plain columns, so
    they stay in generated code. The outer form of explode keeps Spark from
    evaluating the array once more as a filter.
    """
    cfg = F.col("cfg")
    exploded = rows.withColumn("cfg", F.explode_outer("config")).withColumn("line_amount", _amount(cfg))
    overwritten = (F.size("cfg.later") > 0) & F.exists(
        "cfg.later",
        lambda y: A.line_amount(y["amount"], F.col("transaction_amount"), y["data_idx"]) > 0,
    )
    slots = exploded.where(
        (F.col("line_amount") > 0)
        & F.col("cfg.journal_line_number").between(1, F.col("max_line"))
        & ~overwritten
    )
    out = slots.select(
        "journal_id", "setting_type", "setting_description", "journal_date",
        *[F.col(a).alias(b) for a, b in _LINE_HEAD.items()],
        "cfg.journal_line_number", "cfg.account_flag", _account(cfg).alias("account_code"), "cfg.d_c_marker",
        F.col("line_amount").alias("transaction_amount"),
        A.base_amount(F.col("line_amount"), F.col("currency_rate")).alias("base_amount"),
        *_tcodes(cfg),
        "head_complete",
    )
    complete = F.col("head_complete")
    for f in ["account_code", "base_amount", "d_c_marker", *[f"t{i}" for i in range(1, 11)]]:
        complete = complete & F.col(f).isNotNull()
    return out.withColumn("complete", complete).drop("head_complete")


def _gl(rows: DataFrame) -> DataFrame:
    folded = rows.withColumn("g", F.explode_outer(_gl_fold(F.col("config")))).where(F.col("g").isNotNull())
    cfg = F.col("g.cfg")
    codes = [c.alias(f"t_{i}") for i, c in enumerate(_tcodes(cfg), start=1)]
    return folded.select(
        "journal_id", F.col("setting_type").alias("journal_type"),
        F.col("transaction_reference").alias("trx_id"), F.col("journal_date").alias("trx_date"),
        F.col("g.debit").alias("acc_debit"), F.col("g.credit").alias("acc_credit"),
        F.col("g.amount").alias("amount"), cfg["journal_line_number"].alias("journal_line_number"), *codes,
    )


def build_journals(
    settings: DataFrame,
    sources: DataFrame,
    originals: DataFrame | None = None,
    mode: str = "either",
    start: date = START_OF_JOURNALS,
    created_by: int = 0,
) -> Built:
    """Journal headers, their lines, ledger rows and the dropped lines."""
    rows = source_rows(settings, sources, originals, mode, start)
    journals = rows.select(
        F.col("journal_id").alias("id"),
        F.col("id").alias("source_rowid"),
        F.col("setting_type").alias("journal_type"),
        "setting_description",
        "journal_date",
        F.lit(created_by).alias("created_by"),
        F.array("general_description_3").alias("search_id"),
        F.lit(None).cast("string").alias("voucher_id"),
    )
    slots = _lines(rows)
    return Built(
        journals,
        slots.where("complete").drop("complete"),
        _gl(rows),
        slots.where("not complete").drop("complete"),
    )
