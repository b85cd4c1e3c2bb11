"""Fill-in-the-middle texts by counted-quantifier patterns.

A text is a sequence of ``n`` units: a word with the blanks before it, or the blanks at the end. ``regexp_count``
gives ``n``, a hash of the document's id two places in it, and a pattern made for the row, with possessive groups
``unit{a}`` and ``unit{b-a}``, captures prefix, middle and suffix in one match, whose replacement is the output.
Possessive groups are counted in a loop, so a text may have any number of units.

A null text is empty, a null id has no digits. Empty texts, texts that hold a marker, and the share of texts the hash
leaves out stay plain: the output is the text. Rows that share an id are cut by the same hash values. Empty tables
give empty frames. Columns of the input pass through, except those with names of the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, SIGN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = f"{BLANK}*{SIGN}+|{BLANK}+"
#: The same units; blanks and signs exclude each other, so nothing is lost by never giving a sign back.
HELD = f"(?:{BLANK}*+{SIGN}++|{BLANK}++)"
MARKERS = "<[PSM]>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _draw(digest: Column, place: int) -> Column:
    """Group ``place`` (from 1) of eight digits of a digest, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text of an output.

    The text of a cut document holds no marker, and neither can the seam of a part and a marker, since a marker
    has ``<`` at its start and ``>`` at its end only. So the markers found are those put in.
    """
    part = F.split(output, MARKERS, -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` per cent of the texts are cut, ``spm`` per cent of these with the suffix first. One pass over the
    rows, without a shuffle.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digits = F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), digits), 256)
    keep = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
        body.alias("_text"),
        F.regexp_count(body, F.lit(UNIT)).cast("long").alias("n"),
        F.array(*[_draw(digest, k) for k in (1, 2, 3, 4)]).alias("_h"),
    )
    h, n = F.col("_h"), F.col("n")
    plain = (n == 0) | F.col("_text").rlike(MARKERS) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cuts = [h[0] % (n + 1), h[1] % (n + 1)]
    placed = rows.select("_row", "_text", "n", form.alias("form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    pattern = F.format_string(rf"(?s)\A({HELD}{{%d}}+)({HELD}{{%d}}+)(.*)\z", F.col("_a"), F.col("_b") - F.col("_a"))
    order = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    cut = placed.select("_row", "n", "form", output.alias("output"))
    part = F.split("output", MARKERS, -1)
    first = F.when(F.col("form") == "psm", F.char_length(part[1])).when(F.col("form") == "spm", F.char_length(part[2]))
    middle = F.when(F.col("form") != "plain", F.char_length(part[3]))
    return cut.select("_row.*", "n", "form", first.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def middles_sql() -> str:
    """The digest columns of the query over ``documents``."""
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT) AS h{k}" for k in (1, 2, 3, 4))
    return f"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), u AS (
        SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS units, {draws} FROM d
    ), c AS (
        SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
            greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                 WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM u
    ), p AS (
        SELECT doc_id, n, form, t, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
            array_to_string(units[b + 1:], '') AS suf
        FROM c
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
               ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """
