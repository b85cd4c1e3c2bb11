"""Audit of how far the sources of a language differ in their words, by chunk factorization.

A text is cut into chunks at blanks, and the chunks of each document are counted. A task adds these counts up per
chunk and source group before it hands them on, one row a chunk with its groups packed. They are dealt by chunk, once:
each globally distinct chunk becomes one row, is cut into terms there, and its terms meet its counts. So frequent chunks
cost one row per stretch of text, not one per occurrence. A group, (language, source), travels as a hash, seeded so
that no two groups share one; so does a language.

A term is kept if ``min_docs`` documents of its language hold it. Documents cannot be added up over the
chunks of a term, since one document may hold several of them. Yet the largest chunk alone bounds the number from
below and their sum from above; only for terms in between are documents told apart. All chunks of such a term are
in fewer than ``min_docs`` documents of the language, so a second pass lists documents for these chunks alone: a bitmap
of a fixed size lets their hashes through, and an exact join follows. No frequent chunk is listed by document
unless the bitmap mistakes it for a rare one, and then the join drops it.

Null texts, languages and sources are empty strings. Every row is a document of its own, whatever its id. Groups
without terms have rows in the part ``pair``; a language without kept terms has the value 0 there. Ties of a value go
by the item's bytes. An empty table gives an empty frame. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shuffle_partitions, slices, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of text a task counts at once before it hands the counts on.
HELD = 32 << 20
#: An entry of a chunk's counts within a stretch or a task: group, language, documents and occurrences.
ENTRY = np.dtype([("gid", "<i8"), ("lid", "<i8"), ("docs", "<i8"), ("occ", "<i8")])
#: Chunks handed on at once.
ROWS = 1 << 14
#: Bits of the filter for rare chunks: 4 MB, whatever the number of chunks.
BITS = 1 << 25


def _telling(frame: DataFrame, *columns: str) -> Column:
    """A hash of ``columns`` under the first seed by which no two rows of ``frame``, all distinct, share one."""
    many, seed = frame.count(), 0
    while True:
        code = F.xxhash64(F.lit(seed), *columns)
        if frame.select(code).distinct().count() == many:
            return code
        seed += 1


def grouped(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(lang, source, gid, lid) of each group, and the columns that give a row its gid and its language's lid."""
    groups = written(rows.select("lang", "source").distinct(), "source-groups")
    gid, lid = _telling(groups, "lang", "source"), _telling(groups.select("lang").distinct(), "lang")
    return groups.withColumns({"gid": gid, "lid": lid}), gid, lid


def stretches(batches, size: int):
    """Arrow batches put together to stretches of about ``size`` bytes; a longer text makes its stretch longer."""
    pieces, used = [], 0
    for batch in slices(batches, 16):
        pieces.append(batch)
        used += batch.nbytes
        if used >= size:
            yield pa.concat_batches(pieces)
            pieces, used = [], 0
    if pieces:
        yield pa.concat_batches(pieces)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks of ``texts``, and the text and the chunk of each occurrence as numbers."""
    lists = pc.ascii_split_whitespace(texts)
    chunks = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return chunks.dictionary, row, chunks.indices.to_numpy().astype(np.int64)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array that is not empty."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _packed(entries: np.ndarray, first: np.ndarray) -> pa.Array:
    """The entries from each place of ``first`` to the next as one binary value."""
    ends = np.append(first, len(entries)) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries.tobytes())])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all values, and how many each value has."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(ENTRY), np.diff(ends) // ENTRY.itemsize


def chunk_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(chunk, counts): for each chunk of a stretch of ``docs`` (gid, lid, text), its entries by group, packed."""

    def run(batches):
        for batch in stretches(batches, held):
            chunks, row, code = coded(batch.column("text"))
            if not len(code):
                continue
            many = len(chunks)
            row *= many  # arrays are used again, since they are what a task holds
            row += code
            row.sort()  # by document and chunk
            first = _runs(row)
            occ = np.diff(np.append(first, len(row)))
            row, code = np.divmod(row[first], many)
            names, at, group = np.unique(batch.column("gid").to_numpy(), return_index=True, return_inverse=True)
            langs = batch.column("lid").to_numpy()[at]
            code *= len(names)
            code += group[row]  # by chunk and group
            order = np.argsort(code, kind="stable")
            keys = code[order]
            first = _runs(keys)
            total = np.add.reduceat(occ[order], first)
            del row, occ, order
            docs_ = np.diff(np.append(first, len(keys)))
            code, group = np.divmod(keys[first], len(names))
            begin = np.append(_runs(code), len(code))
            for start in range(0, len(begin) - 1, ROWS):
                part = begin[start : start + ROWS + 1]
                span = slice(part[0], part[-1])
                entries = np.empty(part[-1] - part[0], ENTRY)
                entries["gid"], entries["lid"] = names[group[span]], langs[group[span]]
                entries["docs"], entries["occ"] = docs_[span], total[span]
                packed = _packed(entries, part[:-1] - part[0])
                yield pa.RecordBatch.from_arrays([chunks.take(pa.array(code[part[:-1]])), packed], ["chunk", "counts"])

    return docs.mapInArrow(run, "chunk string, counts binary")


def _added(code: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``entries`` by (code, group): codes, entries in the order of languages, documents of the language."""
    names, at, group = np.unique(entries["gid"], return_index=True, return_inverse=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, entries["lid"][at]))] = np.arange(len(names))
    keys = code * len(names) + rank[group]
    order = np.argsort(keys, kind="stable")
    entries, first = entries[order], _runs(keys[order])
    sums = entries[first]
    for name in ("docs", "occ"):
        sums[name] = np.add.reduceat(entries[name], first)
    code = code[order][first]
    lang = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (sums["lid"][1:] != sums["lid"][:-1]))))
    return code, sums, np.repeat(np.add.reduceat(sums["docs"], lang), np.diff(np.append(lang, len(sums))))


def factored(counts: DataFrame, held: int = HELD) -> DataFrame:
    """(chunk, counts, terms), a row per distinct chunk: its counts by group, and its terms.

    The rows of a chunk, one a stretch, are dealt by chunk, sorted and added up while they stream by, so a task holds
    one chunk's groups besides the rows it reads at once. ``least`` of an entry is the chunk's documents in its language.
    """
    dealt = counts.repartition(shuffle_partitions(counts.sparkSession), "chunk").sortWithinPartitions("chunk")

    def run(batches):
        name, kept = None, np.empty(0, ENTRY)
        for batch in stretches(batches, held // 8):
            chunks, (entries, each) = batch.column("chunk"), _unpacked(batch.column("counts"))
            if name is not None:  # the last chunk so far may go on here
                chunks = pa.concat_arrays([pa.array([name], chunks.type), chunks])
                entries, each = np.concatenate((kept, entries)), np.concatenate(([len(kept)], each))
            new = pc.not_equal(chunks.slice(1), chunks.slice(0, len(chunks) - 1)).to_numpy(zero_copy_only=False)
            place = np.concatenate(([0], np.cumsum(new)))
            code, sums, least = _added(np.repeat(place, each), entries)
            name, done = chunks[len(chunks) - 1].as_py(), np.searchsorted(code, place[-1])
            kept = sums[done:].copy()
            if done:
                yield _listed(chunks.take(pa.array(_runs(place)[:-1])), code[:done], sums[:done], least[:done])
        if name is not None:
            code, sums, least = _added(np.zeros(len(kept), np.int64), kept)
            yield _listed(pa.array([name]), code, sums, least)

    summed = dealt.mapInArrow(run, "chunk string, counts array<struct<gid: bigint, lid: bigint, docs: bigint, occ: bigint, least: bigint>>")
    terms = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), 0)
    return summed.where(F.col("chunk").rlike(TERM)).select("chunk", "counts", terms.alias("terms"))


def _listed(chunks: pa.Array, code: np.ndarray, sums: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    names = ("gid", "lid", "docs", "occ")
    entries = pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(sums[n])) for n in names], pa.array(least)], [*names, "least"])
    ends = np.append(_runs(code), len(code)).astype(np.int32)
    return pa.RecordBatch.from_arrays([chunks, pa.ListArray.from_arrays(pa.array(ends), entries)], ["chunk", "counts"])


def term_sums(chunks: DataFrame) -> DataFrame:
    """(lid, gid, term, count, least, most): occurrences, and what each group adds to the bounds of documents."""
    # A term that stands twice in a chunk counts twice, but its documents once.
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("times")))
    rows = chunks.select("counts", F.explode(once).alias("t")).select("t.*", F.inline("counts"))
    sums = F.sum(F.col("occ") * F.col("times")).alias("count"), F.max("least").alias("least"), F.sum("docs").alias("most")
    return rows.groupBy("lid", "gid", "term").agg(*sums)


def chunk_rows(docs: DataFrame, chunks: DataFrame, bits: int, held: int = HELD) -> DataFrame:
    """(lid, chunk, row) of the documents whose chunks have the hashes of ``chunks``; ``row`` numbers documents."""
    at = F.pmod(F.xxhash64("chunk"), F.lit(bits)) + 1
    pages = chunks.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    allowed = np.zeros(bits, bool)
    for page, marked in pages.collect():  # bits / 32768 of them at most
        marks = np.unpackbits(np.frombuffer(marked, np.uint8), bitorder="little").astype(bool)
        start = (page - 1) * len(marks)
        allowed[start : start + len(marks)] = marks[: bits - start]
    filter_ = np.packbits(allowed)

    def run(batches):
        ok, digest = np.unpackbits(filter_).view(bool), functools.partial(xxhash.xxh64_intdigest, seed=42)
        start = TaskContext.get().partitionId() << 40
        for batch in stretches(batches, held):
            chunks, row, code = coded(batch.column("text"))
            h = np.fromiter(map(digest, chunks.cast(pa.binary()).to_pylist()), np.uint64, len(chunks))
            let = np.flatnonzero(ok[h & np.uint64(bits - 1)][code])  # each distinct chunk of a stretch is hashed once
            row, code = np.divmod(np.unique(row[let] * max(len(chunks), 1) + code[let]), max(len(chunks), 1))
            arrays = [batch.column("lid").take(pa.array(row)), chunks.take(pa.array(code)), pa.array(start + row)]
            yield pa.RecordBatch.from_arrays(arrays, ["lid", "chunk", "row"])
            start += batch.num_rows

    return docs.select("lid", "text").mapInArrow(run, "lid long, chunk string, row long")


def kept_terms(docs: DataFrame, chunks: DataFrame, sums: DataFrame, min_docs: int, bits: int = BITS, held: int = HELD) -> DataFrame:
    """(lid, term) in ``min_docs`` documents of the language at least."""
    bounds = sums.groupBy("lid", "term").agg(F.max("least").alias("least"), F.sum("most").alias("most"))
    bounds = written(bounds.where(F.col("most") >= min_docs), "term-bounds")
    open_ = bounds.where(F.col("least") < min_docs).select("lid", "term")
    langs = F.array_distinct(F.transform(F.filter("counts", lambda c: c["least"] < min_docs), lambda c: c["lid"]))
    rare = chunks.select("chunk", "terms", F.explode(langs).alias("lid"))
    rare = rare.select("lid", "chunk", F.explode(F.array_distinct("terms")).alias("term")).join(open_, ["lid", "term"], "left_semi")
    rare = written(rare, "rare-chunks")
    told = chunk_rows(docs, rare, bits, held).join(rare, ["lid", "chunk"]).select("lid", "term", "row").distinct()
    more = told.groupBy("lid", "term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs)
    return bounds.where(F.col("least") >= min_docs).select("lid", "term").union(more.select("lid", "term"))


def _share(count: Column, total: Column, size: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * size)), exact for any count."""
    wide = (count + 2).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, (total + 2 * size).cast("decimal(19,0)"))


F_ = "(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _apart(p: str, q: str) -> Column:
    return F.expr(F_.format(p=p, q=q))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE, held: int = HELD, bits: int = BITS) -> DataFrame:
    """lang, source, part, item, value and rank: the other sources of a language by divergence (``pair``) and the
    ``top`` terms a source has more of than its language (``term``).

    Written on the way: distinct chunks with counts and terms, sums per group and term, kept terms. ``bits`` is a
    power of two.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, gid, lid = grouped(rows)
    placed = rows.select(gid.alias("gid"), lid.alias("lid"), "text")
    chunks = written(factored(chunk_counts(placed, held), held), "chunks")
    sums = written(term_sums(chunks), "term-sums")
    kept = written(kept_terms(placed, chunks, sums, min_docs, bits, held), "kept-terms")
    counts = sums.select("lid", "gid", "term", "count").join(kept, ["lid", "term"], "left_semi")
    counts = written(counts.join(groups, ["lid", "gid"]).select("lang", "source", "term", "count"), "term-counts")
    kept = kept.join(groups.select("lid", "lang").distinct(), "lid")

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("N"), F.count(F.lit(1)).alias("had"))
    groups = groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["N", "had", "V"])
    groups = written(groups.withColumn("p0", F.when(F.col("V") > 0, _share(F.lit(0), F.col("N"), F.col("V"), scale))), "divergence-groups")

    placed = counts.join(groups, ["lang", "source"])
    placed = written(placed.select("lang", "source", "term", "count", _share(F.col("count"), F.col("N"), F.col("V"), scale).alias("p"), "p0"), "term-shares")
    return _pairs(groups, placed).union(_terms(placed, groups, top, scale))


def _pairs(groups: DataFrame, placed: DataFrame) -> DataFrame:
    one = placed.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    two = placed.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    more = _apart("pa", "pb") - _apart("pa", "zb") - _apart("za", "pb") + _apart("za", "zb")
    both = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(more).alias("both"))
    first = groups.select("lang", F.col("source").alias("a"), F.col("V"), F.col("had").alias("ha"), F.col("p0").alias("za"))
    second = groups.select("lang", F.col("source").alias("b"), F.col("had").alias("hb"), F.col("p0").alias("zb"))
    met = first.join(second, "lang").where("a < b").withColumn("none", (F.col("V") - F.col("ha") - F.col("hb")) * _apart("za", "zb"))
    # Terms of one source against the value of absent terms in another: many terms share a count.
    bars = placed.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa")).agg(F.count(F.lit(1)).alias("m"))
    alone = bars.join(second, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * _apart("pa", "zb")).alias("alone"))
    turned = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("turned"))
    parts = met.join(both, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left").join(turned, ["lang", "a", "b"], "left")
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("both", "alone", "turned", "none")), F.lit(0)).cast("long")
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = parts.select("lang", value.alias("value"), sides.alias("_s")).select("lang", "_s.source", "_s.item", "value")
    return _ranked(rows, "pair")


def _terms(placed: DataFrame, groups: DataFrame, top: int, scale: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("N").alias("N"), F.max("V").alias("V"))
    common = placed.groupBy("lang", "term").agg(F.sum("count").alias("c")).join(whole, "lang")
    common = common.select("lang", "term", _share(F.col("c"), F.col("N"), F.col("V"), scale).alias("q"))
    over = placed.join(common, ["lang", "term"]).where("p > q")
    rows = over.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    return _ranked(rows, "term", top)


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def divergence_sql(min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE) -> str:
    """The same rows from all terms of all documents and all kept terms of all sources, without chunks."""
    share = f"1 + ({scale} * (CAST({{c}} AS HUGEINT) + 2)) // ({{n}} + 2 * {{v}})"
    apart = "((p - q) * (p - q)) // (p + q)"
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
        FROM documents
    ), o AS (SELECT id, lang, source, unnest(terms) AS term FROM d
    ), kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {min_docs}
    ), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
    ), grp AS (SELECT DISTINCT lang, source FROM d
    ), counted AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL
    ), grid AS (
        SELECT grp.lang, grp.source, kept.term, coalesce(counted.c, 0) AS c
        FROM grp JOIN kept USING (lang) LEFT JOIN counted ON counted.lang = grp.lang AND counted.source = grp.source AND counted.term = kept.term
    ), n AS (SELECT lang, source, sum(c) AS n FROM grid GROUP BY lang, source
    ), p AS (
        SELECT grid.lang, grid.source, term, c, {share.format(c="c", n="n", v="v")} AS p
        FROM grid JOIN n USING (lang, source) JOIN sizes USING (lang)
    ), q AS (
        SELECT lang, term, {share.format(c="sum(c)", n="any_value(n)", v="any_value(v)")} AS q
        FROM grid JOIN (SELECT lang, sum(c) AS n FROM grid GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
    ), sums AS (
        SELECT lang, source, item, sum({apart}) AS value
        FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
        GROUP BY lang, source, item
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ), terms AS (
        SELECT lang, source, 'term' AS part, term AS item, {apart} AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
