"""A training corpus from raw documents: quality, near copies, repeated passages, source mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents the one before it kept, and returns a frame that
is written as Parquet and read again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.mixing import mix_sources, tempered_weights
from ledgerloom.llm.pieces import encoded
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.simhash import near_groups
from ledgerloom.llm.substring import remove_repeats

#: Power by which the sources' shares are flattened; small sources are repeated until the target is met.
FLATTEN = 0.9


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id, a missing one included, is in ``kept`` (_key)."""
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_key"]), "left_semi")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier predicts to be good; rows that share a doc_id are judged by the best of them."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = scores.groupBy(F.col("doc_id").alias("_key")).agg(F.max("predicted").alias("_good")).where("_good = 1").select("_key")
    return _only(docs, good)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies (4-word shingles, up to 4 of 64 bits): that with the smallest doc_id.

    Of rows that share this doc_id one stays; rows without doc_id stay, since nothing tells them apart.
    """
    groups = near_groups(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_key")).distinct()
    kept = _only(docs, groups)
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages of earlier documents; untouched texts stay as they are.

    A document of which nothing is left goes.
    """
    cut = remove_repeats(docs).where("n_removed IS NULL OR n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    named = {"text": text.alias("text"), "n_chars": chars.alias("n_chars")}
    return cut.select(*[named.get(c, F.col(f"`{c}`")) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the proportions of the target weights, in the order of the schedule.

    No document is left out: small sources are repeated until the largest has been used in full.
    """
    weights = written(tempered_weights(docs, FLATTEN), "weights")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    mixed = mix_sources(docs.select("doc_id", "source", whole), weights, repeat=True)
    return mixed.sort("mix_slot", "mix_row").select("_whole.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, the number of ids and whether decoding gives the text again."""
    return encoded(docs)


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("mixture", mix),
    ("token ids", encode),
]

#: Kernel scores, Hamming components and Viterbi paths are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
