"""Fill-in-the-middle texts, the divergence of sources and near copies among vectors against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, middles, multiindex

LONG = " ".join(f"w{k * k % 997}" for k in range(60_000))
ODD = [
    (1, None, "en", "s"),
    (2, "", "en", None),
    (3, " \n\t ", None, "s"),
    (4, "a<P>b c", "en", "t"),
    (5, "< P> <S <M >", "en", "t"),
    (6, " two  words \x0b\x0c\r\n", "en", "t"),
    (6, " two  words \x0b\x0c\r\n", "en", "t"),
    (7, LONG, "en", "s"),
    (8, "x" * 300_000, "en", "s"),
    (None, "no id, but words", "en", "s"),
    (9, "日本語　ﬁ \U0001f600 text more <", "ja", "s"),
    (10, "nul\x00 in $1 \\2 text", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["n", "form", "output", "prefix_chars", "_h", "_text", "count", "term", "chunk", "rows", "N", "V", "value", "rank"]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH if c not in ("N", "rank")])


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_middle(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (100, 50)])
def test_middles_equal_a_plain_version(odd, rate, spm):
    frame = middles.fill_in_middle(odd, rate, spm).withColumn("back", middles.restored(F.col("output"), F.col("form")))
    rows = frame.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back", "chunk").collect()
    got = sorted((repr(r[:7]) for r in rows))
    assert got == sorted(repr((i, t, *plain_middle(i, t, rate, spm))) for i, t, _, _ in ODD)
    assert all(r.back == (r.text or "") and r.chunk == "extra chunk" for r in rows)


def test_middles_of_empty_frames_and_of_the_table(spark, root):
    assert middles.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = middles.fill_in_middle(docs).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text) for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_middles_have_no_shuffle_and_no_python(odd):
    plan = middles.fill_in_middle(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_divergence(rows, min_docs, top):
    scale, docs = 10**9, [(lang or "", source or "", text or "") for _, text, lang, source in rows]
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    held, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        terms = TERM.findall(text.translate(lower))
        sources[lang].add(source)
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in sources:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 2) // (total + 2 * v) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources[lang]), Counter()))
        p = {s: shares(count[lang, s]) for s in sources[lang]}

        def apart(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources[lang]:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources[lang] if o != s]
            terms = [(apart(p[s][t], whole[t]), t) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return out


@pytest.mark.parametrize("min_docs,held", [(1, 200_000), (2, 200_000), (2, 3), (4, 50)])
def test_divergence_equals_a_plain_version(odd, min_docs, held):
    rows = divergence.source_divergence(odd, min_docs, 3, held=held).collect()
    assert {tuple(r) for r in rows} == plain_divergence(ODD, min_docs, 3) and len(rows) == len({tuple(r) for r in rows})


def test_documents_of_terms_are_told_apart_over_chunks(spark):
    """A term in five chunks, all below the bound: as documents it reaches the bound in one language only."""
    one = [(k, f"the, {w} The", "en", f"s{k % 3}") for k, w in enumerate(["the.", "(the)", "the!", "'the'", "the;"])]
    two = [(k, "the. (the) the! 'the' the;", "de", f"s{k % 2}") for k in range(4)]
    three = [(k, f"other x{k}", "fr", "s0") for k in range(6)] + [(99, "", "fr", "s1")]
    rows = one + two + three
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for min_docs in (3, 4, 5, 6, 7):
        for bits in (1 << 15, 8):  # eight bits let all chunks through
            got = {tuple(r) for r in divergence.source_divergence(frame, min_docs, 10, held=2, bits=bits).collect()}
            assert got == plain_divergence(rows, min_docs, 10)


def test_counts_beyond_64_bits_of_products_stay_exact(spark):
    big = 3 * 10**12
    frame = spark.createDataFrame([(big, 2 * big, 7)], "c long, n long, v long")
    got = frame.select(divergence._share(F.col("c"), F.col("n"), F.col("v"), 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (2 * big + 14)


def test_divergence_of_an_empty_frame(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_links(vectors, cosine=0.95):
    """Links and the smallest id reachable of each (id, vector)."""
    usable = [k for k, (_, v) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(vectors), list(range(len(vectors)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, i in enumerate(usable):
        for j in usable[n + 1 :]:
            a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
            if len(a) == len(b) and multiindex.exactly(a, b) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)), key=lambda k: vectors[k][0])
                parent[y] = x
    return sorted((v[0], links[k], vectors[top(k)][0]) for k, v in enumerate(vectors))


VECTORS = "vec_id long, embedding array<double>, label int"


def clustered(n, width, seed, noise, centres=40, tail=0.3):
    """Vectors around uneven centres, of uneven lengths."""
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal((centres, width))
    at = np.minimum(draw.geometric(tail, n), centres) - 1
    return (centre[at] + noise * draw.standard_normal((n, width))) * draw.lognormal(0, 1, (n, 1))


def test_near_vectors_with_whole_traversal_equal_all_pairs(spark):
    x = clustered(400, 8, 1, 0.35)
    rows = [(k * 7 % 401, v.tolist(), None) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[k][1], 1) for k in range(30)] + [(2000 + k, rows[0][1], 1) for k in range(50)]
    rows += [(3000, None, 0), (3001, [0.0] * 8, 0), (3002, [1.0, None] * 4, 0), (3003, [float("nan")] * 8, 0), (3004, [1.0, 2.0], 0)]
    rows += [(3005, [1e200] * 8, 0), (3006, [1e-200] * 8, 0), (3007, [float("inf")] + [1.0] * 7, 0)]
    frame = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit("x").alias(c) for c in ("node", "m", "vec", "least", "n_links", "cell")])
    with np.errstate(all="ignore"):
        want = plain_links([r[:2] for r in rows if r[0] < 3000])
    for tile in (4096, 40):
        got = multiindex.near_vectors(frame, recall=1, residents=16, tile=tile).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 3000) == want
        rest = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id >= 3000}
        assert all(rest[k] == (0, k, True) for k in (3000, 3001, 3002, 3003, 3004, 3007))
        assert rest[3005] == (1, 3005, True) and rest[3006] == (1, 3005, False)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("width,noise", [(16, 0.2), (64, 0.22)])
def test_near_vectors_reach_the_recall_and_find_no_false_link(spark, width, noise):
    x = clustered(3000, width, width, noise, centres=200, tail=0.03)
    frame = spark.createDataFrame([(k, v.tolist(), None) for k, v in enumerate(x)], VECTORS)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    got = np.array([r.n_links for r in multiindex.near_vectors(frame, residents=16).orderBy("vec_id").collect()])
    assert want.sum() > 2000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_traversal_visits_the_nearest_cells_in_order():
    draw = np.random.default_rng(2)
    found = multiindex.unit(draw.standard_normal((500, 12)))
    grid = multiindex.fit(found, 32_000, 0.95, 0.99)
    row, cell = grid.visits(found)
    one, two = grid.excess(found)
    cost = (one[:, :, None] + two[:, None, :]).reshape(len(found), -1)
    for k in range(len(found)):
        mine = cell[row == k]
        assert set(mine) == set(np.flatnonzero(cost[k] <= grid.limit)) and len(set(mine)) == len(mine)
        assert (np.diff(cost[k][mine]) >= -1e-12).all() and mine[0] == grid.homes(found[k : k + 1])[0]


def test_near_vectors_of_rows_without_id_and_of_empty_frames(spark):
    rows = [(None, [1.0, 0.0], 0), (None, None, 0), (5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [0.0, 2.0], 0), (7, [1.0, 0.01], 0)]
    got = multiindex.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr)
    assert found == sorted([(None, 0, None, True), (None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)], key=repr)
    assert multiindex.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert multiindex.near_vectors(spark.createDataFrame([(1, None, 0)], VECTORS)).collect()[0].n_links == 0
