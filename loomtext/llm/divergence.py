"""Audit of how the sources of each language differ in their words.

Terms are found on the bytes of slices of texts, which are counted there, and then
summed by (language, source, term); each language keeps the terms that enough of its
documents hold. A kept term becomes one wide row, an array of counts
with a place for each source of the language; higher-order functions turn the
counts to smoothed shares and emit, for each pair of sources, the term's share of
their divergence, which is summed map-side. So a term's row is as long as its
language has sources, and neither documents nor terms of a source are gathered.

Shares are whole numbers, ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``, and a
term's contribution is ``floor((p - q)^2 / (p + q))``. All arithmetic is of 64-bit
whole numbers and exact while a language has less than 2.8e14 term occurrences.

Defined cases: a null text, language or source is the empty string; a null id is
a document like any other, as each row is one; empty texts and those without terms
still make their (language, source) occur; a language without kept terms has
pairs of value 0 and no terms; a language of one source has no pairs; ties are
ranked by the item's bytes; a very long text is one row's work; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import _LOWER, slices, small_batches, stored, table

#: Documents of a language that must hold a term, ranks of terms that are reported.
LEAST, TOP = 10, 10
SCALE = 1_000_000_000
#: SCALE in two factors, so that products stay below 2^63.
_BY, _AND = 32_000, 31_250
#: Most (language, source) groups whose totals are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Bytes of a term: letters, and what is beyond ASCII.
_TERM = np.array([k > 127 or chr(k).isalpha() for k in range(256)])


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, with repeats and in order, and the text that each
    is of; A-Z in lower case. Works on the UTF-8 bytes of the whole array."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = _TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = (offsets[1:-1] - offsets[0])[offsets[1:-1] < offsets[-1]]
    first[edge] = inside[edge]
    at = np.flatnonzero(first)
    kept = np.cumsum(inside)
    starts = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    # the terms' bytes, one term behind the other
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]])])
    return found, np.searchsorted(offsets - offsets[0], at, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of each slice of a batch."""
    for batch in slices(batches, "text"):
        found, text = terms(batch.column("text"))
        names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
        number: dict[tuple, int] = {}
        group = np.array([number.setdefault((x["lang"], x["source"]), len(number)) for x in names.to_pylist()], np.int64)
        coded = found.dictionary_encode()
        code, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        if not kinds:
            continue
        # each term of a text with its occurrences there, then of a group
        each, n = np.unique(text * kinds + code, return_counts=True)
        key, place = np.unique(group[each // kinds] * kinds + each % kinds, return_inverse=True)
        langs, sources = (pa.array([x[i] for x in number], pa.string()) for i in (0, 1))
        of = pa.array(key // kinds)
        yield pa.RecordBatch.from_arrays(
            [langs.take(of), sources.take(of), coded.dictionary.take(pa.array(key % kinds)).cast(pa.binary()).cast(pa.string()), pa.array(np.bincount(place, n).astype(np.int64)), pa.array(np.bincount(place).astype(np.int64))],
            names=["lang", "source", "term", "n", "docs"],
        )


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents with the term.
    Tasks give the sums of their slices of texts, which Spark adds up by term."""
    small_batches(docs.sparkSession)
    each = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division in
    two steps."""
    a, b = count + F.lit(2).cast("bigint"), total + 2 * kept
    high = a * F.lit(_BY).cast("bigint")
    return F.lit(1).cast("bigint") + _div(high, b) * F.lit(_AND).cast("bigint") + _div((high % b) * F.lit(_AND).cast("bigint"), b)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.call_function("div", a, b)


def contribution(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    # one row a term: its counts by source
    narrow = counts(docs)
    kept = narrow.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")).where(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "by_source"), "terms")
    totals = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    known = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("x"))
    known = stored(known.join(vocabulary, "lang", "left").select("lang", F.col("x.source").alias("sources"), F.col("x.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v")), "languages")
    few = groups.count() <= BROADCAST_GROUPS
    whole = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    wide = kept.join(F.broadcast(known) if few else known, "lang").select(
        "lang", "term", "sources", "totals", "v", F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s), F.lit(0)).cast("bigint")).alias("n")
    )
    wide = stored(
        wide.select(
            "lang", "term", "n", F.transform("n", lambda c, i: share(c, F.get("totals", i), F.col("v"))).alias("p"), share(whole(F.col("n")), whole(F.col("totals")), F.col("v")).alias("q")
        ),
        "wide",
    )
    # pairs of places i < j, each term's contribution to them
    size = F.size("p")
    pairs = F.flatten(
        F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.transform(F.sequence(i + 1, size - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), contribution(F.get("p", i), F.get("p", j)).alias("f"))))
    )
    summed = stored(wide.where(size > 1).select("lang", F.inline(pairs)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value")), "pairs")
    at = known.where(F.size("sources") > 1).select("lang", F.posexplode("sources").alias("i", "source"), "sources").select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    both = summed.unionByName(summed.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    of_pairs = at.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = of_pairs.withColumn("rank", F.row_number().over(order))
    above = F.filter(F.transform("p", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: (x["p"] > F.col("q")) & (F.get("n", x["i"]) > 0))
    named = known.select("lang", F.posexplode("sources").alias("i", "source"))
    of_terms = wide.select("lang", "term", "q", F.inline(above)).select("lang", "i", F.col("term").alias("item"), contribution(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    best = of_terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    of_terms = best.join(named, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return of_pairs.unionByName(of_terms)


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gt AS (SELECT lang, source, sum(n) AS total FROM full_ GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n::HUGEINT + 2)) // (total + 2 * v) AS p FROM full_ JOIN gt USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 2)) // (any_value(lt.total) + 2 * any_value(v)) AS q FROM full_ JOIN (SELECT lang, sum(total) AS total FROM gt GROUP BY lang) lt USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""
