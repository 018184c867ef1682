"""Audit of how a chain of document filters interacts, over all their orders.

Every document is told once which filters it fails, a mask. Documents are then
counted in cells (part, mask), at most ``2 ** filters`` rows a part, and all
orders are worked out from the cells alone: orders are visited so that each
differs from the one before by one swap of neighbours, and a swap changes only
the two steps it touches. A filter's Shapley count, the sum over all orders of
what it removes, is added up along the walk.

Duplicates are told by text digests (SHA-256) without gathering a group of
copies: rows of a digest are first summed by part, mask and labels, each with its
smallest id and how many rows have that id; a group of copies is then a handful
of sums whatever its size. Texts are never shuffled.

Defined cases: a null text is empty, a null part is the empty string; a null id
has no label and is neither a copy nor an original; rows of one id and text are
the same document seen twice, both counted, neither a copy of the other; a
document whose ``labels`` rows differ counts as good (toxic) if any says so; a
very long text is one row's work; ties can't arise; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches, stored, table

FILTERS = "ABCDE"
#: Statistics of a step, and the cell counts they need.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * F.size(words).cast("bigint"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failed filters;
    bit i of the mask is filter i of ``FILTERS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = failures(text)
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *(v.alias(k) for k, v in fails.items()))
    mask = sum((F.col(k).cast("int") * F.lit(1 << FILTERS.index(k)) for k in fails), F.lit(0))
    told = stored(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    told = told.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask")).join(told, "doc_id", "left")
    same = ["digest", "part", "mask", "good", "toxic"]
    once = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    # of each kind of copy: all rows, those without an id, and the smallest id with its rows
    kinds = once.groupBy(*same).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("apart"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")
    )
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    original = F.col("apart") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    kinds = kinds.withColumn("first", first).select("part", "mask", "good", "toxic", "n", original.alias("original"))
    copy = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("original")).alias("n"))))
    return (
        kinds.select("part", "good", "toxic", split.alias("x")).groupBy("part", "x.mask")
        .agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    )


def swaps(n: int) -> Iterator[int]:
    """Places k to exchange with k + 1, so that from the order 0, 1, ... every
    permutation of ``n`` is visited once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        # the last element walks through an order of the others, one place a swap
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)
        down = not down


def walk(cell: np.ndarray, filters: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Every order with ``(filters, 5, parts)``: kept, removed, redundant, good
    and toxic lost of its steps. ``cell`` is (3, masks, parts): all, good, toxic
    documents. The array given is changed by the next step of the walk."""
    masks = np.arange(1 << filters)
    total = cell[0].sum(0)

    def step(before: int, f: int) -> np.ndarray:
        fails, gone = masks >> f & 1 == 1, masks & before != 0
        here = fails & ~gone
        return np.stack([cell[0][masks & (before | 1 << f) == 0].sum(0), cell[0][here].sum(0), cell[0][fails & gone].sum(0), cell[1][here].sum(0), cell[2][here].sum(0)])

    order = list(range(filters))
    before = [(1 << i) - 1 for i in range(filters)]
    stats = np.zeros((filters, 5, len(total)), np.int64)
    for i in range(filters):
        stats[i] = step(before[i], order[i])
    yield tuple(order), stats
    for k in swaps(filters):
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        for i in (k, k + 1):
            stats[i] = step(before[i], order[i])
        yield tuple(order), stats


def audit(cells_: DataFrame, names: str = FILTERS) -> DataFrame:
    """``part, filter_order, step`` and ``COUNTS`` from ``cells``. A part's
    cells come to a task as arrays of ``2 ** len(names)`` counts."""
    filters = len(names)
    small_batches(cells_.sparkSession)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    count = lambda mask, name: F.coalesce(F.element_at("m", F.lit(mask))[name], F.lit(0)).cast("bigint")
    wide = cells_.groupBy("part").agg(by_mask.alias("m")).select("part", *(F.array(*(count(i, c) for i in range(1 << filters))).alias(c) for c in ("n", "good", "toxic")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.num_rows
            cell = np.stack([np.array(batch.column(c).flatten()).reshape(parts, -1).T for c in ("n", "good", "toxic")])
            unique = np.stack([cell[0][1 << f] for f in range(filters)])
            shapley = np.zeros((filters, parts), np.int64)
            seen = []
            for order, stats in walk(cell, filters):
                shapley[list(order)] += stats[:, 1]
                seen.append((order, stats.copy()))
            for order, stats in seen:
                of = list(order)
                columns = dict(zip(("kept", "removed", "redundant", "good_lost", "toxic_lost"), stats.transpose(1, 2, 0)))
                columns |= {"unique_fails": unique[of].T, "shapley": shapley[of].T}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(batch.column("part").to_pylist(), object), filters), pa.string()),
                        pa.array(["".join(names[f] for f in order)] * (parts * filters)), pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), parts)),
                        *(pa.array(np.ascontiguousarray(columns[c]).ravel().astype(np.int64)) for c in COUNTS),
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return wide.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "lang"))


SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * caps > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
grow AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM grow, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS x, substr(filter_order, 1, s - 1) AS before FROM grow, (SELECT unnest(range(1, 6)) AS s) WHERE length(filter_order) = 5),
told AS (SELECT part, filter_order, step, x, n, good, toxic, fails = x AS only_here, contains(fails, x) AS failing,
  before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone FROM steps, c),
r AS (SELECT part, filter_order, step, x,
  CAST(sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN only_here THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
