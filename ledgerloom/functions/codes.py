"""Account and transaction codes, keys and document numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An account setting containing one of these words is looked up
# in the source row instead of being used as it stands.
ACCOUNT_KEYWORDS = [
    "BANK",
    "PREMI",
    "PIUTANG",
    "UTANG",
    "KLAIM",
    "KONTRIBUSI",
    "RUTIN",
    "REMUN",
    "FEE",
    "APPROPRIATE",
    "BIAYA",
    "KOMISI",
]

DEFAULT_LOCATION_CODE = "3174"
VOUCHER_SEQUENCE_DIGITS = 4
MAX_VOUCHER_SEQUENCE = 9999


def is_lookup_account(setting: Column) -> Column:
    """Whether a setting names a kind of account rather than an account."""
    return F.upper(F.trim(setting)).rlike("|".join(ACCOUNT_KEYWORDS))


def account_code(setting: Column, lookup: Column, data_idx: Column) -> Column:
    """Element ``data_idx`` (0-based) for keyword settings, else the setting."""
    return F.when(is_lookup_account(setting), F.get(lookup, data_idx)).otherwise(setting)


def tcode(setting: Column, values: Column, data_idx: Column | None = None) -> Column:
    """Setting code, else the source element; blank becomes 'N/A', NULL stays."""
    code = F.coalesce(setting, F.get(values, F.lit(0) if data_idx is None else data_idx))
    return F.when(F.trim(code) == "", "N/A").otherwise(code)


def normalised_account(code: Column) -> Column:
    """Trimmed upper-case code; an empty code is NULL."""
    clean = F.upper(F.trim(code))
    return F.when(clean != "", clean)


def is_ten_digit_account(code: Column) -> Column:
    return code.rlike("^[0-9]{10}$")


def stable_key(*parts: Column) -> Column:
    """Digest key in place of a random identifier, so a rerun gives the same."""
    text = [F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *text), 256)


def group_digest(*parts: Column) -> Column:
    """MD5 grouping key over quoted parts."""
    first, *rest = parts
    return F.md5(F.concat_ws("|", first, *[F.concat(F.lit('"'), p, F.lit('"')) for p in rest]))


def voucher_number(journal_type: Column, day: Column, seq: Column) -> Column:
    return F.concat(
        journal_type,
        F.date_format(day, "yyMMdd"),
        F.lpad(seq.cast("string"), VOUCHER_SEQUENCE_DIGITS, "0"),
    )


def voucher_description(description: Column, day: Column, seq: Column) -> Column:
    tail = F.lpad(seq.cast("string"), VOUCHER_SEQUENCE_DIGITS, "0")
    return F.substring(
        F.concat(description, F.lit(" "), day.cast("string"), F.lit("/"), tail), 1, 50
    )


def je_number(day: Column, source_rowid: Column) -> Column:
    return F.concat(F.lit("JE-"), F.date_format(day, "yyyyMM"), F.lit("-"), source_rowid)


def batch_je_number(template_code: Column, day: Column, seq: Column) -> Column:
    return F.concat(
        F.lit("JE-"),
        F.substring(template_code, 1, 4),
        F.lit("-"),
        F.date_format(day, "yyyyMMdd"),
        F.lit("-"),
        F.lpad(seq.cast("string"), 10, "0"),
    )


def is_reversal(journal_type: Column) -> Column:
    """Odd second character marks a reversal type; NULL when it is no digit."""
    return F.substring(journal_type, 2, 1).try_cast("int") % 2 == 1


def opposite_side(dc: Column) -> Column:
    return F.when(dc == "D", "C").otherwise("D")


def lookup_or_default(code: Column, known: Column, default: str = DEFAULT_LOCATION_CODE) -> Column:
    """``code`` where the joined dimension column ``known`` is present."""
    return F.when(known.isNotNull(), code).otherwise(F.lit(default))
