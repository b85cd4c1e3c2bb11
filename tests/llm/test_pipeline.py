"""The stages of the corpus pipeline against plain versions, on given and on odd rows."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from ledgerloom.llm.quality import quality_scores  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k * k % 997}" for k in range(20_000))


@pytest.fixture(scope="module")
def docs(spark, root):
    """Given documents, near copies and repeated passages of them, and odd rows."""
    given = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    draw, rows = random.Random(5), list(given)
    long_ = [r for r in given if len(r[1].split()) > 150][:6]
    for k, (_, text, lang, source, n) in enumerate(long_):
        words = text.split()
        rows.append((10_000 + k, text, lang, source, n))
        rows.append((11_000 + k, " ".join(words[: len(words) // 2] + [f"new{draw.random()}" for _ in range(200)]), lang, source, n))
    rows += [(20_000, None, "en", "s", 0), (20_001, "", None, None, None), (20_002, LONG, "en", "s", 5), (20_003, LONG, "en", "t", 5)]
    rows += [(20_003, LONG, "en", "t", 5), (None, "no id but some words", "en", "t", 3), (None, "no id but some words", "en", "t", 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in ("_key", "component_id", "n_removed", "ids", "mix_slot", "score", "weight")])


def rows_of(frame):
    return Counter(map(repr, map(tuple, frame.collect())))


def test_quality_keeps_what_the_classifier_accepts(spark, root, docs):
    kept = pipeline.keep_quality(spark, docs, root)
    scores = quality_scores(docs, spark.read.parquet(f"{root}/labels.parquet")).select("doc_id", "predicted").collect()
    good = {r.doc_id for r in scores if r.predicted == 1}
    assert kept.columns == docs.columns and 0 < len(good) < len({r.doc_id for r in scores})
    assert rows_of(kept) == Counter(repr(tuple(r)) for r in docs.collect() if r.doc_id in good)


def test_near_copies_leave_the_smallest_of_each_group(spark, root, docs):
    kept = pipeline.drop_near_copies(spark, docs, root)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    group = brute.groups({r.doc_id: brute.simhash(r.text or "") for r in rows})
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({g for g in group.values()})
    assert all(10_000 + k not in {r.doc_id for r in got} for k in range(6))


def test_repeats_go_and_clean_texts_stay(spark, root, docs):
    cut = pipeline.cut_repeats(spark, docs, root)
    assert cut.columns == docs.columns
    rows = docs.where("doc_id < 20000").collect()
    plain = brute.substring([(r.doc_id, r.text) for r in rows])
    text = {r.doc_id: r.text for r in rows}
    got = {r.doc_id: r.text for r in cut.where("doc_id < 20000").collect()}
    for i, (n, removed, digest) in plain.items():
        if n and removed == n:
            assert i not in got
        elif not removed:
            assert got[i] == text[i]
        else:
            assert brute.substring([(0, got[i])])[0][2] == digest
    assert any(0 < removed < n for n, removed, _ in plain.values())


def test_the_mixture_leaves_no_document_out(spark, root, docs):
    mixed = pipeline.mix(spark, docs, root)
    have, want = rows_of(mixed), rows_of(docs)
    assert mixed.columns == docs.columns and set(have) == set(want) and all(have[r] >= want[r] for r in want)


def test_token_ids_give_the_texts_back(spark, root, docs):
    coded = pipeline.encode(spark, docs, root).collect()
    assert len(coded) == docs.count() and all(r.round_trip in (True, None) for r in coded)
    assert all(r.round_trip for r in coded if r.text)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_take_empty_tables(spark, root, docs, stage):
    assert stage(spark, docs.limit(0), root).collect() == []


def test_run_goes_through_all_stages(spark, root):
    out = pipeline.run(spark, root)
    assert {"doc_id", "text", "lang", "source", "n_chars", "ids"} <= set(out.columns) and out.count() > 0
