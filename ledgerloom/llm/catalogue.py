"""Registered queries of the text operators, with comparison SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ledgerloom.llm.ctw import lm_scores
from ledgerloom.llm.divergence import divergence_sql, source_divergence
from ledgerloom.llm.licences import scan_licences, scan_sql
from ledgerloom.llm.middles import fill_in_middle, middles_sql, restored
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.multiindex import near_vectors
from ledgerloom.llm.parsing import document_fingerprints
from ledgerloom.llm.permutation import nearest
from ledgerloom.llm.pieces import encoded
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.sharding import proportional_shards
from ledgerloom.llm.simhash import hex64, near_groups
from ledgerloom.llm.substring import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query("op1_license_scan", scan_sql())
def op1(spark, root):
    return scan_licences(table(spark, root, "documents"))


@query("op3_sharding")
def op3(spark, root):
    return proportional_shards(table(spark, root, "documents"))


@query("op5_source_mixing")
def op5(spark, root):
    mixed = mix_sources(table(spark, root, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_slot", "mix_row", "in_mix", "mix_ticks")


@query("op9_simhash_groups")
def op9(spark, root):
    groups = near_groups(table(spark, root, "documents"))
    return groups.select("doc_id", hex64(F.col("f0")).alias("fingerprint"), "component_id")


@query("op2_substring_dedup")
def op2(spark, root):
    cut = remove_repeats(table(spark, root, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_document_fingerprints")
def op10(spark, root):
    return document_fingerprints(table(spark, root, "documents"))


@query("op7_lm_scores")
def op7(spark, root):
    return lm_scores(table(spark, root, "documents"))


@query("op6_quality_classifier")
def op6(spark, root):
    return quality_scores(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op8_nearest_vectors")
def op8(spark, root):
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_sentencepiece")
def op4(spark, root):
    return encoded(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "ids", "round_trip")


@query("op11_fill_in_middle", middles_sql())
def op11(spark, root):
    cut = fill_in_middle(table(spark, root, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op12_embedding_copies")
def op12(spark, root):
    return near_vectors(table(spark, root, "embeddings"))


@query("op13_source_divergence", divergence_sql())
def op13(spark, root):
    return source_divergence(table(spark, root, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, root):
    return corpus_pipeline.run(spark, root)
