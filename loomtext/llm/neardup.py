"""N-gram Jaccard join by chosen paths, and near-duplicate classes.

A text is the set of its five-word shingles. Equal sets are one set from the
start and are joined once. Every set gets a sketch of ``T`` min-hash tokens
(one-permutation hashing). Chosen paths: a node of the search tree samples
``BRANCH`` sketch places, and every set of the node goes to one child for each
sampled place, named by the token it has there; so sets meet in a child if they
share a sampled token. A node of one set ends; one of at most ``SMALL`` sets,
one that hardly shrank, or one at ``DEPTH`` is a bucket and is joined by brute
force. ``runs`` trees are built, as many as the target recall at the threshold
asks for.

A bucket is joined through representatives, so that a large group of near
copies costs rows in proportion to its size. First every set is compared with
the bucket's first one, sketches first and then whole sets; while more than a
few tiles' sets of a bucket stand outside of its largest connected group, all that
is not connected with one of them is compared with that one, for as long as
this is worth its while. Connected sets need no further comparison; the sets of
a bucket that are not yet connected with each other are compared in tiles of
bounded size: a tile
never pairs sets of one connected group, so a group takes part in as many tiles
as the sets outside of it fill. Tiles give direct links that connect what the
tile's links connect. Classes are the connected components. Then every two sets
of a class are compared whole, in tiles of bounded size: the result is the list
of all these links between representatives (``pairs``), or their number for
each document, plus membership. A link of a class needs no path of its own to be
found; only one that no tree connects is left out.

Defined cases: null, empty and wordless texts link with nothing and are classes
of their own; a text of one to four words is one shingle; very long texts are
sets like others, tiles being bounded by shingles too; ties keep the smallest
id; repeated rows count as copies; rows of one id with different texts are
classed text by text; a null id keeps its row, with a null class; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, types
from pyspark.sql import functions as F

from ._shared import NOT_WORD, by_groups, components, mix, shingles, slices, small_batches, stored, table, thinned, word_hashes

WIDTH, SIMILARITY = 5, 0.8
T = 64
BRANCH, DEPTH, SMALL, RECALL = 3, 6, 1000, 0.995
#: A child with more than this share of its parent's sets is joined at once.
TIGHT = 0.75
TILE_SETS, TILE_SHINGLES = 800, 2_000_000
#: Most rounds of representatives, and the share of its sets that a round has to
#: link for another one to follow; what is left then is for the tiles.
ROUNDS, WORTH = 6, 0.05
#: Tiles' sets outside of a bucket's largest connected group that call for one.
CROWDED = 4
#: Sketch agreement from which whole sets are compared: 5 deviations below.
LIKELY = SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / T)


def runs(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Trees needed so that a pair at ``similarity`` meets with ``recall``."""
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - (1 - similarity * p) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending within each text, and where texts start."""
    words, starts = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")), space=NOT_WORD)
    value, owner = shingles(words, starts, WIDTH)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


_PLACES = np.stack([np.random.default_rng(k).integers(0, T, T) for k in range(24)])


def sketches(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, T) tokens: the least hash of each place; an empty place takes
    the token of a place that it draws, the same for all texts."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    place = (value >> np.uint64(58)).astype(np.int64)
    key = owner * T + place
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    out = np.zeros(n * T, np.uint32)
    have = np.zeros(n * T, bool)
    out[key[first]] = (value[first] >> np.uint64(20)).astype(np.uint32)
    have[key[first]] = True
    out, have = out.reshape(n, T), have.reshape(n, T)
    filled = have.copy()
    for draw in [*_PLACES, *[(np.arange(T) + k) % T for k in range(1, T)]]:
        if filled.all() or not have.any():
            break
        take = ~filled & have[:, draw]
        out = np.where(take, out[:, draw], out)
        filled |= take
    return out


def _fingerprints(value: np.ndarray, starts: np.ndarray) -> list[bytes]:
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(value))])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return [a.tobytes() + b.tobytes() for a, b in zip(one[starts[1:]] - one[starts[:-1]], two[starts[1:]] - two[starts[:-1]])]


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n, key, sketch`` of every row; without shingles or without an
    id there is no key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, starts = sets_of(batch.column("text"))
            n = np.diff(starts)
            usable = (n > 0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            sketch, key = sketches(value, starts), _fingerprints(value, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array([k if u else None for k, u in zip(key, usable)], pa.binary()), pa.array([x.tobytes() if u else None for x, u in zip(sketch, usable)], pa.binary())],
                names=["doc_id", "n", "key", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n bigint, key binary, sketch binary")


def _children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, BRANCH different places that its node samples, and the
    children that the row's tokens name."""
    out = np.empty((len(node), BRANCH), np.uint64)
    taken = np.zeros((len(node), T), bool)
    rows = np.arange(len(node))
    for k in range(BRANCH):
        at = (mix(node + np.uint64(k + 1)) % np.uint64(T)).astype(np.int64)
        for _ in range(BRANCH):
            at = np.where(taken[rows, at], (at + 1) % T, at)
        taken[rows, at] = True
        out[:, k] = mix(mix(node * np.uint64(31) + at.astype(np.uint64)) + sketch[rows, at].astype(np.uint64))
    return np.repeat(rows, BRANCH), out.ravel()


def _branched(rows: DataFrame, roots: int) -> DataFrame:
    """``node, rep, n, size`` of the children; ``rows(rep, n, sketch[, node,
    size])``. With roots, each row stands at that many roots."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, T)
            rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            size = batch.column("size").to_numpy() if not roots else np.zeros(len(rep), np.int64)
            starts = [mix(np.full(len(rep), k + 1, np.uint64)) for k in range(roots)] or [batch.column("node").to_numpy().view(np.uint64)]
            for node in starts:
                row, child = _children(node, sketch)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[row]), pa.array(n[row]), pa.array(size[row])], names=["node", "rep", "n", "size"])

    return rows.mapInArrow(work, "node bigint, rep bigint, n bigint, size bigint").dropDuplicates(["node", "rep"]) if not roots else rows.mapInArrow(work, "node bigint, rep bigint, n bigint, size bigint")


def buckets(reps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``leaf, rep, n`` of the chosen-path trees over ``reps(rep, n, sketch)``."""
    level, leaves = _branched(reps.select("rep", "n", "sketch"), runs(similarity, recall)), None
    for depth in range(1, DEPTH + 1):
        level = stored(level, "path")
        counts = level.groupBy("node").agg(F.count("*").alias("count")).where("count > 1")
        level = level.join(counts, "node")
        ends = (F.col("count") <= SMALL) | (F.col("count") > TIGHT * F.col("size")) & (F.col("size") > 0) | F.lit(depth == DEPTH)
        done = level.where(ends).select(F.col("node").alias("leaf"), "rep", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth == DEPTH:
            break
        rest = stored(level.where(~ends).select("node", "rep", "n", F.col("count").alias("size")), "path")
        if rest.isEmpty():
            break
        level = _branched(rest.join(reps.select("rep", "sketch"), "rep"), 0)
    return leaves


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose sketches agree in enough places."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, T) for c in ("sketch", "other"))
        yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= LIKELY * T))


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose shingle sets are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("shingles").to_pylist(), batch.column("other").to_pylist()):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(both * (1 + similarity) >= similarity * (len(one) + len(two)) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(group: pa.Table) -> np.ndarray:
    """(n, n): the pairs of a tile that are its own to compare: of different
    connected groups, and across the tile's two parts if it has two."""
    whole = group.column("whole").to_numpy()
    pairs = whole[:, None] != whole[None, :]
    if group.column("a")[0].as_py() != group.column("b")[0].as_py():
        part = group.column("part").to_numpy()
        pairs &= part[:, None] != part[None, :]
    return pairs


def _likely(group: pa.Table) -> pa.Table | None:
    """The sets of a tile that have a likely partner in it."""
    n = group.num_rows
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(n, T)
    agree = np.zeros((n, n), bool)
    for i in range(n - 1):
        agree[i, i + 1 :] = (sketch[i + 1 :] == sketch[i]).sum(1) >= LIKELY * T
    hit = np.flatnonzero(((agree | agree.T) & _apart(group)).any(1))
    return group.take(pa.array(hit)).select(["leaf", "a", "b", "part", "rep", "whole"]) if len(hit) else None


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of ascending arrays: columns that many
    sets have by matrix products, the others by their pairs."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[cut, len(flat)])
    total = np.zeros((n, n))
    dense = np.flatnonzero(count > max(2, n // 16))
    for a in range(0, len(dense), 2048):
        some = dense[a : a + 2048]
        m = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), count[some])
        at = np.repeat(cut[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(len(column))
        m[who[at], column] = 1
        total += m @ m.T
    for size in range(2, max(2, n // 16) + 1):
        start = cut[count == size]
        for i in range(size) if len(start) else ():
            for j in range(i + 1, size):
                np.add.at(total, (who[start + i], who[start + j]), 1)
    upper = np.triu(total, 1)
    for_pairs = np.tril(total, -1)
    return np.maximum(upper, for_pairs.T) + np.maximum(upper, for_pairs.T).T


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric (n, n) matrix of links."""
    left = links.any(1)
    out: list[tuple[int, int]] = []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        for i in queue:
            new = np.flatnonzero(links[i] & left)
            left[new] = False
            out += [(int(i), int(j)) for j in new]
            queue += new.tolist()
    return out


def _linked(group: pa.Table, similarity: float) -> pa.Table | None:
    """Direct links of a tile that connect what all its links connect."""
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], float)
    links = (intersections(sets) * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9) & _apart(group)
    edges = forest(links)
    if not edges:
        return None
    rep = group.column("rep").to_numpy()
    return pa.table({"a": rep[[i for i, _ in edges]], "b": rep[[j for _, j in edges]]})


def _matrix(group: pa.Table, similarity: float) -> np.ndarray:
    """(n, n): which sets of a tile are linked, of its own pairs."""
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], float)
    links = intersections(sets) * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
    np.fill_diagonal(links, False)
    if group.column("a")[0].as_py() != group.column("b")[0].as_py():
        part = group.column("part").to_numpy()
        links &= part[:, None] != part[None, :]
    return links


def _counted(group: pa.Table, similarity: float) -> pa.Table:
    """For each set of a tile the documents of the sets linked with it there."""
    return pa.table({"rep": group.column("rep"), "links": _matrix(group, similarity) @ group.column("copies").to_numpy()})


def _listed(group: pa.Table, similarity: float) -> pa.Table:
    """The links of a tile."""
    i, j = np.nonzero(np.triu(_matrix(group, similarity)))
    rep = group.column("rep").to_numpy()
    return pa.table({"a": np.maximum(rep[i], rep[j]), "b": np.minimum(rep[i], rep[j])})


def within_classes(docs: DataFrame, reps: DataFrame, roots: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on tiles of the sets of each class of ``roots(rep, whole)``,
    which compare every two of its sets once: a class is dealt out to parts, each
    about a tile's sets, and a tile is a part or a pair of parts. So memory is
    bounded, and only what a tile computes grows with the square of a class."""
    members = stored(roots.join(reps.select("rep", "n", "copies"), "rep"), "members")
    parts = members.groupBy("whole").agg(F.ceil(F.sum(_weight()) / TILE_SETS).cast("int").alias("parts"))
    dealt = members.join(parts, "whole").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("others", F.sequence(F.lit(0), F.col("parts") - 1))
    # joined before it is dealt out: a row for each set, not one for each of its tiles
    sets = _with_sets(docs, reps, members.select("rep"))
    return by_groups(_dealt(dealt.join(sets, "rep"), "whole", ["rep", "copies", "shingles"]), ["whole", "a", "b"], work, schema)


def _dealt(placed: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``name, a, b, part`` and the ``columns`` of ``placed(name, part, others)``,
    a row for each of the tiles that a part makes with the ``others``."""
    each = placed.select(name, "part", *columns, F.explode("others").alias("other"))
    return each.select(name, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", *columns)


def _with_sets(docs: DataFrame, reps: DataFrame, needed: DataFrame) -> DataFrame:
    """``rep, shingles`` of the ``needed(rep)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, starts = sets_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_fingerprints(value, starts), pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["key", "shingles"]
            )

    wanted = stored(needed.distinct().join(reps.select("rep", "key", "doc_id"), "rep"), "needed")
    of_ids = thinned(docs.where("doc_id is not null"), wanted.select("doc_id").distinct(), "left_semi")
    # another text of a needed id has another key
    return of_ids.mapInArrow(work, "key binary, shingles binary").join(wanted.select("rep", "key"), "key").select("rep", "shingles").dropDuplicates(["rep"])


def _stars(leaves: DataFrame, first: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of sets with ``first(leaf, b)`` of a bucket they are in."""
    star = leaves.join(first.select("leaf", "b"), "leaf").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    star = star.join(reps.select(F.col("rep").alias("a"), "sketch"), "a").join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("other")), "b")
    star = stored(star.select("a", "b", "sketch", "other").mapInArrow(_agreeing, "a bigint, b bigint"), "star")
    sets = _with_sets(docs, reps, star.select(F.col("a").alias("rep")).unionByName(star.select(F.col("b").alias("rep"))))
    sets = stored(sets, "sets")
    star = star.join(sets.select(F.col("rep").alias("a"), "shingles"), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("other")), "b")
    return stored(star.select("a", "b", "shingles", "other").mapInArrow(lambda x: _similar(x, similarity), "a bigint, b bigint"), "stars")


def _rooted(links: DataFrame) -> DataFrame:
    """``rep, whole`` of the sets that links connect."""
    return stored(components(links, "near").select(F.col("node").alias("rep"), F.col("root").alias("whole")), "near")


def connected(leaves: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` with representatives of the buckets, and ``rep, whole``
    of the sets that they connect."""
    first = leaves.groupBy("leaf").agg(F.min("rep").alias("b"))
    links = _stars(leaves, first, reps, docs, similarity)
    roots, full = _rooted(links), leaves
    for turn in range(1, ROUNDS):
        placed = stored(full.join(roots, "rep", "left").select("leaf", "rep", "n", F.coalesce("whole", "rep").alias("whole")), "placed")
        groups = placed.groupBy("leaf", "whole").agg(F.sum(_weight()).alias("weight"))
        main = groups.groupBy("leaf").agg(F.max_by("whole", F.struct("weight", "whole")).alias("main"), (F.sum("weight") - F.max("weight")).alias("outside")).where(F.col("outside") > CROWDED * TILE_SETS)
        full = stored(placed.join(main.select("leaf", "main"), "leaf"), "full")
        if full.isEmpty():
            break
        # drawn anew in each bucket, so that the buckets of a group try different ones
        first = full.where("whole <> main").groupBy("leaf").agg(F.min_by(F.struct("rep", "whole"), F.xxhash64("rep", "leaf", F.lit(turn))).alias("x"))
        first = stored(first.select("leaf", F.col("x.rep").alias("b"), F.col("x.whole").alias("known")), "first")
        others = full.join(first.select("leaf", "known"), "leaf").where("whole <> known").select("leaf", "rep")
        new = _stars(others, first, reps, docs, similarity)
        gain = new.count()
        if not gain:
            break
        roots = _rooted(new.unionByName(roots.select(F.col("rep").alias("a"), F.col("whole").alias("b"))))
        links = links.unionByName(new)
        if gain < WORTH * full.count():
            break
        full = full.select("leaf", "rep", "n")
    return links, roots


def _weight():
    """Of a set of ``n`` shingles, in sets of a tile."""
    return F.greatest(F.lit(1.0), F.col("n") * F.lit(TILE_SETS / TILE_SHINGLES))


def tiles(leaves: DataFrame, whole: DataFrame) -> DataFrame:
    """``leaf, a, b, part, rep, whole``: the sets of each bucket but its first,
    dealt out to tiles; ``whole(rep, whole)`` names what is connected already."""
    return _dealt(_placed(leaves, whole), "leaf", ["rep", "whole"])


def _placed(leaves: DataFrame, whole: DataFrame) -> DataFrame:
    """``leaf, rep, whole, part, others``: the part that each set of ``tiles`` is
    in, and the parts that it makes tiles with, in one row.

    A connected group as heavy as a tile or heavier takes parts of its own; the
    others, heaviest first, share parts. A tile is a pair of parts, and none is
    made of one group alone."""
    first = leaves.groupBy("leaf").agg(F.min("rep").alias("first"), F.count("*").alias("sets")).where("sets > 2")
    rest = leaves.join(first, "leaf").where("rep <> first").join(whole, "rep", "left")
    # stored, as it is read several times below: the joins above make a row for each set of a bucket once
    rest = stored(rest.select("leaf", "rep", F.coalesce("whole", "rep").alias("whole"), _weight().alias("weight")), "rest")
    groups = rest.groupBy("leaf", "whole").agg(F.sum("weight").alias("weight"))
    many = groups.groupBy("leaf").agg(F.count("*").alias("groups")).where("groups > 1").select("leaf")
    large = F.col("weight") >= TILE_SETS
    own = F.when(large, F.ceil(F.col("weight") / TILE_SETS)).otherwise(0).cast("int")
    light = F.when(large, 0.0).otherwise(F.col("weight"))
    before = Window.partitionBy("leaf").orderBy(F.desc("weight"), "whole").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(many, "leaf").select(
        "leaf", "whole", own.alias("own"), (F.coalesce(F.sum(own).over(before), F.lit(0)) + F.floor(F.coalesce(F.sum(light).over(before), F.lit(0.0)) / TILE_SETS)).cast("int").alias("start")
    )
    placed = stored(placed, "parts")
    parts = placed.groupBy("leaf").agg(F.max(F.col("start") + F.greatest("own", F.lit(1))).alias("parts"))
    part = F.col("start") + F.when(F.col("own") > 1, F.pmod(F.xxhash64("rep", "leaf"), F.col("own"))).otherwise(0).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (F.col("own") == 0) | (p < F.col("start")) | (p >= F.col("start") + F.col("own")))
    return rest.join(placed, ["leaf", "whole"]).join(parts, "leaf").select("leaf", "rep", "whole", part.alias("part"), other.alias("others"))


def _classed(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``rep, key, doc_id, copies, class_id, class_key`` of the representatives;
    ``doc_id, key`` of all rows; and, for ``within_classes``, ``reps`` and
    ``roots``. A class is named by its smallest id (and key)."""
    spark = docs.sparkSession
    small_batches(spark)
    sketched = stored(_sketched(docs), "sketch")
    reps = sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    leaves = stored(buckets(reps, similarity), "leaves")
    _, roots = connected(leaves, reps, docs, similarity)
    keys = ["leaf", "a", "b"]
    # sketches and sets are joined to sets, not to a set's rows in its tiles, which grow with the square of a bucket
    dealt = _dealt(_placed(leaves, roots).join(reps.select("rep", "sketch"), "rep"), "leaf", ["rep", "whole", "sketch"])
    likely = stored(by_groups(dealt, keys, _likely, "leaf bigint, a int, b int, part int, rep bigint, whole bigint"), "likely")
    if not likely.isEmpty():
        sets = _with_sets(docs, reps, likely.select("rep"))
        places = likely.groupBy("rep").agg(F.collect_list(F.struct("leaf", "a", "b", "part", "whole")).alias("x"))  # at most a set's tiles
        each = places.join(sets, "rep").select("rep", F.inline("x"), "shingles")
        more = stored(by_groups(each, keys, lambda g: _linked(g, similarity), "a bigint, b bigint"), "linked")
        roots = _rooted(more.unionByName(roots.select(F.col("rep").alias("a"), F.col("whole").alias("b"))))
    slim = reps.select("rep", "key", "doc_id", "copies")
    linked = stored(roots.join(slim, "rep").select("rep", "whole", "doc_id", "key"), "classes")
    names = linked.groupBy("whole").agg(F.min(F.struct("doc_id", "key")).alias("name"))
    linked = linked.join(names, "whole").select("rep", "name")
    named = slim.join(linked, "rep", "left").select(
        "rep", "key", "doc_id", "copies", F.coalesce("name.doc_id", "doc_id").alias("class_id"), F.coalesce("name.key", "key").alias("class_key")
    )
    return named, sketched.select("doc_id", "key"), reps, roots


def _narrowed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All links ``doc_id, other_id`` between representatives (of equal sets
    the smallest id) of one class."""
    docs = _narrowed(docs)
    named, _, reps, roots = _classed(docs, similarity)
    links = within_classes(docs, reps, roots, lambda g: _listed(g, similarity), "a bigint, b bigint")
    name = named.select("rep", "doc_id")
    return links.join(name.withColumnRenamed("rep", "a"), "a").join(name.select(F.col("rep").alias("b"), F.col("doc_id").alias("other_id")), "b").select("doc_id", "other_id")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs(doc_id, text)``:
    the smallest id of its class, and the number of documents it is joined with
    directly: those of equal sets, and those of the sets that ``pairs`` joins
    with its own, which are counted in the tiles and not listed."""
    docs = _narrowed(docs)
    named, sketched, reps, roots = _classed(docs, similarity)
    counts = within_classes(docs, reps, roots, lambda g: _counted(g, similarity), "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    named = named.join(counts, "rep", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    found = sketched.where("key is not null").join(named.select("key", "class_id", "n_links"), "key").select("doc_id", "class_id", "n_links")
    # rows without shingles, each its own class
    alone = sketched.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return found.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest id, one row of it.
    Rows without words and rows without an id stay; so do null texts, empty
    tables and extra columns as they are. Very long texts count like others;
    of rows of one id each text stands for itself."""
    narrow = _narrowed(docs)
    named, sketched, _, _ = _classed(narrow)
    named = stored(named.select("key", "class_id", "class_key"), "classes")
    sketched = sketched.where("key is not null")
    twice = stored(sketched.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    losing = sketched.join(named, "key").where("doc_id <> class_id or key <> class_key").select("doc_id").distinct()
    if twice.isEmpty():
        return thinned(docs, stored(losing, "losing"), "left_anti")
    # ids of several rows: row by row, of equal ones the first
    losing = stored(losing.join(twice, "doc_id", "left_anti"), "losing")
    names = docs.columns
    mark = next(f"key{k}" for k in range(len(names) + 1) if f"key{k}" not in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, starts = sets_of(batch.column("text"))
            key = [k if n else None for k, n in zip(_fingerprints(value, starts), np.diff(starts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], names=[*batch.schema.names, mark])

    marked = thinned(docs, twice, "left_semi").mapInArrow(work, types.StructType([*docs.schema.fields, types.StructField(mark, types.BinaryType())]))
    winners = named.where("key = class_key").select(F.col("key").alias(mark), F.col("class_id").alias("doc_id")).distinct()
    kept = marked.where(F.col(mark).isNotNull()).join(winners, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    again = kept.unionByName(marked.where(F.col(mark).isNull())).select(*[F.col(f"`{c}`") for c in names])
    return thinned(thinned(docs, losing, "left_anti"), twice, "left_anti").unionByName(again)
