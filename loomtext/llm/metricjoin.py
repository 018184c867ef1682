"""Exact metric range join of embeddings.

Vectors of one label and length link if their cosine is ``SIMILARITY`` or more;
on the unit sphere that is a Euclidean distance of at most r. Equal vectors are
joined once. Labels with many vectors are partitioned by pivots: a vector's
home is the cell of its nearest pivot, and it is copied to each other cell that
a vector within r of it could have as home. By the triangle inequality that
takes d(x, q) - d(x, p) <= 2r, and in Euclidean space also that the plane
between the pivots is within r of x. Each cell is then joined on its own, in
tiles of at most about ``TILE`` x ``TILE`` vectors, so a crowded cell costs more
tasks and not more memory. An ordered pair is counted where the second vector is
at home, so counts are exact without listing pairs; each vector also gives the
smallest one it reaches in the tile, and components are those of these links.

At most ``MAX_PIVOTS`` pivots are broadcast; labels beyond that are one cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; so do vectors whose
lengths differ; labels may be of any type; norms may be beyond a double's range;
ties keep the smallest id; repeated rows count as copies; rows with a null id
link with nothing; a very long vector is one row of its tile; an empty table gives an
empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import by_groups, components, small_batches, stored, table

SIMILARITY = 0.93
CELL, TILE = 2000, 1500
MAX_PIVOTS = 8192


#: Cosines so near to the threshold are taken again, pair by pair.
NEAR = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which
    rounds nothing and keeps squares from overflowing or vanishing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors in double precision, of arrays of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """(len(x), len(y)): whether cosines reach the threshold. Near to it a
    cosine doesn't depend on which vectors stand in the matrices."""
    found = unit(x) @ unit(y).T
    links = found >= similarity
    i, j = np.nonzero(np.abs(found - similarity) <= NEAR)
    a, b = scaled(x)[i], scaled(y)[j]
    links[i, j] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= similarity
    return links


def _pivots(reps: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of the labels with more than CELL vectors, at most MAX_PIVOTS."""
    large = reps.groupBy("label", "dim").count().where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dim").limit(MAX_PIVOTS // 2).collect()
    if not large:
        return {}
    total = sum(math.ceil(r["count"] / CELL) for r in large)
    scale = min(1.0, MAX_PIVOTS / total)
    wanted = {(r["label"], r["dim"]): (max(2, int(scale * math.ceil(r["count"] / CELL))), r["count"]) for r in large}
    shares = reps.sparkSession.createDataFrame([(k[0], k[1], min(1.0, 4 * n / c + 20 / c)) for k, (n, c) in wanted.items()], "label string, dim int, share double")
    draw = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = reps.join(F.broadcast(shares), ["label", "dim"]).where(draw < F.col("share")).select("label", "dim", "rep", "vec").orderBy("label", "dim", F.xxhash64("rep", F.lit(5))).collect()
    found: dict[tuple[str, int], list] = {}
    for r in drawn:
        some = found.setdefault((r.label, r.dim), [])
        if len(some) < wanted[r.label, r.dim][0]:
            some.append(r.vec)
    return {k: unit(np.array(v, np.float64)) for k, v in found.items()}


def _cells(x: np.ndarray, pivots: np.ndarray | None, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether the cell is the row's home, copies included."""
    if pivots is None:
        n = len(x)
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))
    home = d.argmin(1)
    near = d[np.arange(len(x)), home][:, None]
    between = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))[home]
    reach = (d - near <= 2 * r + 1e-9) & (d * d - near * near <= 2 * r * between + 1e-9)
    reach[np.arange(len(x)), home] = True
    row, cell = np.nonzero(reach)
    return row, cell, home[row] == cell


def _join(group: pa.Table, similarity: float) -> pa.Table | None:
    at_home = group.column("at_home").to_numpy()
    if at_home.all() or not at_home.any():
        return None
    x = matrix(group.column("vec"))
    rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    probe, home = np.flatnonzero(~at_home), np.flatnonzero(at_home)
    links = similar(x[probe], x[home], similarity) & (rep[probe][:, None] != rep[home][None, :])
    hit = links.any(1)
    if not hit.any():
        return None
    links = links[hit]
    low, other = rep[probe][hit], rep[home]
    big = np.iinfo(np.int64).max
    while True:  # smallest id reached over the tile's links
        new = np.minimum(low, np.where(links, other[None, :], big).min(1))
        other = np.minimum(other, np.where(links, new[:, None], big).min(0))
        new = np.minimum(new, np.where(links, other[None, :], big).min(1))
        if (new == low).all():
            break
        low = new
    # both sides tell what they reach: else a link of two vectors that each
    # reach another, smaller one would be lost to the components
    met = links.any(0)
    counts = np.concatenate([(links @ copies[home]).astype(np.int64), np.zeros(int(met.sum()), np.int64)])
    return pa.table({"rep": np.concatenate([rep[probe][hit], rep[home][met]]), "low": np.concatenate([low, other[met]]), "links": counts})


def range_join(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of
    ``vectors(vec_id, embedding, label)``."""
    small_batches(vectors.sparkSession, 4096)
    r = math.sqrt(2 - 2 * similarity)
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    good = v.where(usable)
    reps = stored(
        good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "label", F.size("vec").alias("dim"), "vec"),
        "vectors",
    )
    pivots = vectors.sparkSession.sparkContext.broadcast(_pivots(reps))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for k in sorted(set(zip(label.tolist(), dim.tolist()))):
                part = batch.take(pa.array(np.flatnonzero((label == k[0]) & (dim == k[1]))))
                row, cell, at_home = _cells(unit(matrix(part.column("vec"))), pivots.value.get(k), r)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(at_home)], names=[*part.schema.names, "cell", "home"])

    dealt = stored(reps.mapInArrow(deal, "rep bigint, copies bigint, label string, dim int, vec array<double>, cell bigint, home boolean"), "cells")
    keys = ["label", "dim", "cell"]
    size = dealt.groupBy(*keys).agg(F.ceil(F.sum(F.col("home").cast("int")) / TILE).cast("int").alias("homes"), F.ceil(F.count("*") / TILE).cast("int").alias("probes"))
    dealt = dealt.join(size.where("homes > 0"), keys)
    own = F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int")
    probing = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("probes")).cast("int")
    columns = [*keys, "rep", "copies", "vec"]
    as_home = dealt.where("home").select(*columns, own.alias("j"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("i"), F.lit(True).alias("at_home"))
    as_probe = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("j"), probing.alias("i"), F.lit(False).alias("at_home"))
    linked = stored(by_groups(as_home.unionByName(as_probe), [*keys, "j", "i"], lambda g: _join(g, similarity), "rep bigint, low bigint, links bigint"), "links")
    roots = components(linked.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vectors")
    found = (
        reps.select("rep", "copies", "label", "vec")
        .join(linked.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = good.join(found, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(v.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {SIMILARITY}),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""
