"""Removal of byte strings that an earlier document has, by a logarithmic family of suffix arrays.

Documents come in batches, in the order of their ids. A batch's suffix array is
merge-scanned, in one pass, with itself and with the arrays of all levels before
it, for strings of ``LENGTH`` bytes in common; then the batch becomes a level, and
levels of equal size are merged, so that there are as many levels as the number of
batches has binary digits, and each suffix is rewritten a logarithmic number of times.

Only matches of ``LENGTH`` bytes count, so suffixes are compared by their first
``LENGTH`` bytes. Of any ``LENGTH`` bytes, one of the strings of ``GRAM`` bytes inside has
the smallest hash; it is their anchor, and equal strings have equal anchors. The
following suffixes with one anchor (27 at most) make one row of an array: the anchor's
hash, by which arrays are sorted and dealt out, and the text that these suffixes
begin with. A level holds each such row once, whatever the number of documents it is in,
and no ids, as all of a level's ids are smaller than those of the next batch.

Where all documents are known beforehand, ``shared`` finds first the anchors that
several documents have; no others are put in an array, and copies of a
whole text aren't either. An anchor of more than ``HOT`` rows isn't one task's work: its
suffixes are dealt out one by one, by their bytes, and their smallest ids found map-side.

Defined cases: a null text is empty; a text of fewer than ``LENGTH`` bytes, like an
empty one, loses nothing; a very long text is hashed in pieces of ``PIECE`` bytes, whatever it is; rows
of one id are one document in several pieces: they lose nothing to each other, each
is judged by itself, and repeated rows give repeated results; a null id is neither earlier
nor later than any, so its row stays whole and removes nothing; of equal texts
the one of the smallest id stays; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import _remove, work_dir
from ._shared import _INVERSES, _ODD, _POWERS, _TABLE, BROADCAST_IDS, _power, mix, slices, small_batches, stored, table, trim

LENGTH, GRAM = 50, 24
#: Batches of the query; documents of an even share of the ids each.
BATCHES = 4
#: Rows of one anchor beyond which its suffixes are dealt out one by one.
HOT = 20_000
PIECE = 1 << 18
#: Rows that a task compares at once, and more up to the end of an anchor.
TOGETHER = 3_000
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written in here go when it is done."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``stored``, without the shuffle files that made it."""
    with freeing(df.sparkSession):
        return stored(df, tag)


# Hashes, anchors and suffixes of texts.


_UP, _DOWN = (np.multiply.accumulate(np.full(PIECE + LENGTH, x, np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` following bytes."""
    n = len(raw) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    codes = _TABLE[raw]
    codes *= _UP[: len(raw)] if len(raw) <= len(_UP) else _power(_POWERS, np.arange(len(raw), dtype=np.int64))
    np.cumsum(codes, out=codes)
    total = codes[width - 1 :].copy()
    total[1:] -= codes[: n - 1]
    total *= _DOWN[:n] if n <= len(_DOWN) else _power(_INVERSES, np.arange(n, dtype=np.int64))
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins (one entry more)."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` following values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def anchors_of(raw: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a suffix array: the anchor's hash, its text, where the
    first and the last of its suffixes begin in all bytes. The anchor of a string
    is its leftmost smallest gram by the hashes' upper half."""
    n = len(raw) - LENGTH + 1
    found = []
    sizes = np.diff(offsets)
    for base in range(0, max(0, n), piece):
        part = raw[base : base + piece + LENGTH - 1]
        count = len(part) - LENGTH + 1
        whole = np.zeros(count + 1, np.int32)
        inside = (sizes >= LENGTH) & (offsets[:-1] < base + count) & (offsets[1:] - LENGTH >= base)
        np.add.at(whole, np.maximum(offsets[:-1][inside] - base, 0), 1)
        np.add.at(whole, np.minimum(offsets[1:][inside] - LENGTH + 1 - base, count), -1)
        whole = np.cumsum(whole[:-1]) > 0
        h = gram_hashes(part, GRAM)
        at = (_smallest(h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.ones(count, bool)
        change[1:] = at[1:] != at[:-1]
        head, tail = whole.copy(), whole.copy()
        head[1:] &= change[1:] | ~whole[:-1]
        tail[:-1] &= change[1:] | ~whole[1:]
        first = np.flatnonzero(head)
        found.append((mix(h[at[first]] ^ np.uint64(LENGTH)).view(np.int64), first + base, np.flatnonzero(tail) + base))
    if not found:
        return (np.empty(0, np.int64),) * 4
    key, first, last = (np.concatenate(x) for x in zip(*found))
    return key, np.searchsorted(offsets, first, "right") - 1, first, last


def anchors(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``key, doc_id, place, more`` of all suffix rows of ``docs(doc_id, text)``:
    the place is the first suffix's beginning times 32 and how many follow it.
    An anchor that a text repeats is one row; ``more`` has its later places."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = _bytes_of(batch.column("text"))
            key, text, first, last = anchors_of(raw, offsets, piece)
            place = (first - offsets[text]) * 32 + (last - first)
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()))
            order = np.argsort(mix(key.view(np.uint64) + text.astype(np.uint64) * np.uint64(_ODD)), kind="stable")
            key, text, place = key[order], text[order], place[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            for a in range(0, len(key), 1 << 17):
                k, t, p, h = (x[a : a + (1 << 17)] for x in (key, text, place, head))
                h[:1] = True
                at = np.flatnonzero(h)
                ends = np.concatenate([[0], np.cumsum(np.diff(np.append(at, len(h))) - 1)]).astype(np.int32)
                none = np.concatenate([np.diff(ends) == 0, [False]])
                more = pa.ListArray.from_arrays(pa.array(ends, mask=none), pa.array(p[~h]))
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(ids[t[at]]), pa.array(p[at]), more], names=["key", "doc_id", "place", "more"])

    return docs.select("doc_id", "text").mapInArrow(work, "key bigint, doc_id bigint, place bigint, more array<bigint>")


def each_place(found: DataFrame) -> DataFrame:
    """``key, doc_id, place``: a row for each place of ``anchors``."""
    every = F.when(F.col("more").isNull(), F.array("place")).otherwise(F.concat(F.array("place"), "more"))
    return found.select("key", "doc_id", F.explode(every).alias("place"))


def shared(found: DataFrame) -> DataFrame:
    """The places of those ``anchors`` that several documents have. An anchor
    has at most a row for each document, a small share of all documents' anchors."""
    of = Window.partitionBy("key")
    both = found.withColumns({"low": F.min("doc_id").over(of), "high": F.max("doc_id").over(of)})
    return each_place(both.where("low <> high"))


def suffixes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``key, doc_id, ver, start, span``: rows of a suffix array for the given
    ``places`` of ``docs(doc_id, ver, text)``; a span is the text from the first
    of its suffixes to the end of the last one's ``LENGTH`` bytes. Rows of one id
    are all cut at its places: what of it isn't an anchor there is harmless, as it is
    the document's text all the same, under a key that none else has."""
    small_batches(docs.sparkSession)
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = _bytes_of(batch.column("text"))
            lists = batch.column("at")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            key, place = (np.asarray(flat.field(i)) for i in (0, 1))
            first, more = place >> 5, place & 31
            fits = first + more + LENGTH <= np.diff(offsets)[rows]
            key, rows, first, more = (x[fits] for x in (key, rows, first, more))
            ids, vers = (np.asarray(batch.column(c).cast(pa.int64())) for c in ("doc_id", "ver"))
            for a in range(0, len(key), 1 << 15):
                k, r, f, size = (x[a : a + (1 << 15)] for x in (key, rows, first, more + LENGTH))
                ends = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(offsets[r] + f - ends[:-1], size) + np.arange(ends[-1])
                span = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[take])])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[r]), pa.array(vers[r]), pa.array(f), span], names=["key", "doc_id", "ver", "start", "span"])

    return docs.select("doc_id", "ver", "text").join(by_doc, "doc_id").mapInArrow(work, "key bigint, doc_id bigint, ver bigint, start bigint, span binary")


# Levels.

_FOUND = "doc_id bigint, ver bigint, start bigint, stop bigint"
_OLD = np.iinfo(np.int64).min


def _whole_anchors(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, regrouped in batches of about ``rows`` that end
    where an anchor does."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        if size >= rows and len(change := np.flatnonzero(key != last)):
            held.append(batch.slice(0, change[0]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            trim() if size > 20 * rows else None
            batch = batch.slice(change[0])
            held, size = [], 0
        held.append(batch)
        size, last = size + batch.num_rows, key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return np.ndarray(len(raw) - 7, np.uint64, np.ascontiguousarray(raw), strides=(1,))


#: Where eight bytes are compared, so that all of a string are.
_AT = [*range(0, LENGTH - 8, 8), LENGTH - 8]


def _compare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Which bytes of the new rows some row with a smaller id has; the suffixes
    of whole anchors are compared at once, sorted by hash, equal ones by bytes."""
    key = np.asarray(batch.column("key"))
    ids = np.asarray(pc.fill_null(batch.column("doc_id"), _OLD)).astype(np.int64)
    # an anchor that only one document has, or only old rows, tells nothing
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(ids, head) < np.maximum.reduceat(ids, head)
    use = np.repeat(several, np.diff(np.append(head, len(key))))
    batch, ids = batch.filter(pa.array(use)), ids[use]
    raw, offsets = _bytes_of(batch.column("span"))
    count = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + ordinal
    h = gram_hashes(raw, LENGTH)[at]
    owner = ids[row]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        words, place = _words(raw), at[order]
        one, two = place[1:][same], place[:-1][same]
        if any((words[one + k] != words[two + k]).any() for k in _AT):
            # two strings of one hash: tell them apart by their bytes
            text = raw.tobytes()
            number: dict[bytes, int] = {}
            h = np.array([number.setdefault(text[i : i + LENGTH], len(number)) for i in at.tolist()], np.uint64)
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(order), bool)
    if len(order):
        head = np.concatenate([[True], ~same])
        owners = owner[order]
        hit[order] = owners > np.minimum.reduceat(owners, np.flatnonzero(head))[np.cumsum(head) - 1]
    hit &= owner != _OLD
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    start, ver = (np.asarray(pc.fill_null(batch.column(c), 0)).astype(np.int64)[row[a]] for c in ("start", "ver"))
    return pa.RecordBatch.from_arrays([pa.array(ids[row[a]]), pa.array(ver), pa.array(start + ordinal[a]), pa.array(start + ordinal[b] + LENGTH)], names=["doc_id", "ver", "start", "stop"])


def scan(new: DataFrame, old: DataFrame | None, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """``doc_id, ver, start, stop``: bytes of the batch ``new`` that lie in a string
    of ``LENGTH`` bytes of ``old``, or of a smaller id in ``new``. Arrays are merged by
    anchor; anchors of more than ``hot`` rows (so few that they are broadcast) apart."""
    small_batches(new.sparkSession)
    rows = new if old is None else new.unionByName(old, allowMissingColumns=True)
    many = kept(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot")
    any_hot = not many.isEmpty()
    cold = rows.join(F.broadcast(many), "key", "left_anti") if any_hot else rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_anchors(batches, together):
            yield _compare(batch)

    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cold.select("key", "span", "doc_id", "ver", "start").repartition(n, "key").sortWithinPartitions("key").mapInArrow(work, _FOUND)
    if not any_hot:
        return found
    each = rows.join(F.broadcast(many), "key", "left_semi").select(
        "doc_id", "ver", "start", F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("span") - LENGTH), lambda i: F.substring("span", i + 1, F.lit(LENGTH)))).alias("i", "string")
    )
    id_ = F.coalesce("doc_id", F.lit(_OLD))
    least = kept(each.groupBy("string").agg(F.min(id_).alias("least")), "least")
    repeated = each.where("doc_id is not null").join(least, "string").where("doc_id > least")
    return found.unionByName(repeated.select("doc_id", "ver", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + LENGTH).alias("stop")))


class Levels:
    """The index family. ``add`` batches in the order of their documents' ids."""

    def __init__(self, hot: int = HOT, together: int = TOGETHER):
        self.hot, self.together = hot, together
        self.levels: list[tuple[int, DataFrame, str]] = []

    def _level(self, df: DataFrame) -> tuple[DataFrame, str]:
        spark = df.sparkSession
        path = f"{work_dir(spark)}/level-{uuid.uuid4().hex}"
        with freeing(spark):
            df.groupBy("key", "span").agg(F.count("*").alias("_")).select("key", "span").sortWithinPartitions("key", "span").write.option("compression", "zstd").parquet(path)
        return spark.read.schema("key bigint, span binary").parquet(path), path

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """What ``batch``, rows of ``suffixes``, repeats of what was added before
        and of its own smaller ids, stored. The ``last`` batch isn't put in a level."""
        old = None
        for _, level, _ in self.levels:
            old = level if old is None else old.unionByName(level)
        found = kept(scan(batch, old, self.hot, self.together), "repeats")
        if not last:
            df, path = self._level(batch)
            self.levels.append((1, df, path))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (size, a, one), (_, b, two) = self.levels.pop(), self.levels.pop()
                df, path = self._level(a.unionByName(b))
                self.levels.append((2 * size, df, path))
                for gone in (one, two):
                    _remove(weakref.ref(batch.sparkSession), gone)
        return found

    def close(self) -> None:
        for _, df, path in self.levels:
            _remove(weakref.ref(df.sparkSession), path)
        self.levels = []


# The whole table.


def version(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text)


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, ver, size`` of the texts that a smaller id has as a whole."""
    rows = docs.where("doc_id is not null").select("doc_id", "ver", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size"))
    several = kept(rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest", "low"), "several")
    return kept(rows.join(several, "digest").where("doc_id > low").select("doc_id", "ver", "size").distinct(), "copies")


def repeats(docs: DataFrame, batches: int = BATCHES, hot: int = HOT, together: int = TOGETHER, piece: int = PIECE) -> DataFrame:
    """``doc_id, ver, cuts``: for each row of ``docs(doc_id, ver, text)`` that loses
    any, its ranges (start, stop) of bytes that an earlier document has."""
    again = copies(docs)
    once = docs.where("doc_id is not null").join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, ["doc_id", "ver"], "left_anti")
    places = kept(shared(anchors(once, piece)), "places")
    bounds = places.agg(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)], 10_000)).first()[0] if batches > 1 else []
    bounds = sorted(set(bounds or []))
    family = Levels(hot, together)
    found = []
    for i in range(len(bounds) + 1):
        within = F.lit(True)
        if i:
            within = within & (F.col("doc_id") > bounds[i - 1])
        if i < len(bounds):
            within = within & (F.col("doc_id") <= bounds[i])
        batch = kept(suffixes(once.where(within), places.where(within)), "suffixes")
        found.append(family.add(batch, last=i == len(bounds)))
    family.close()
    whole = again.where(F.col("size") >= LENGTH).select("doc_id", "ver", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop"))
    for f in found:
        whole = whole.unionByName(f)
    return kept(whole.groupBy("doc_id", "ver").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "cuts")


def with_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", version(text).alias("ver"), text.alias("text"))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[head], stop[np.append(np.flatnonzero(head)[1:] - 1, len(stop) - 1)]


def remaining(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, kept`` (binary) of each row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            texts = batch.column("text").cast(pa.binary())
            lists = batch.column("cuts")
            ends, flat = np.asarray(lists.offsets), lists.values
            start, stop = (np.asarray(flat.field(i)) for i in (0, 1))
            there = np.asarray(lists.is_valid())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                a, b = ends[i], ends[i + 1]
                if not there[i] or a == b:
                    out.append((len(text), 0, 0, text))
                    continue
                s, e = merged(start[a:b], stop[a:b])
                left = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
                out.append((len(text), len(text) - len(left), len(s), left))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    both = docs.select("doc_id", "ver", "text").join(cuts, ["doc_id", "ver"], "left").select("doc_id", "text", "cuts")
    return both.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_rows(table(spark, sf_dir, "documents"))
    return remaining(docs, repeats(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Every string of 50 bytes by itself: hexadecimal digits, so that a byte is two.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, i, h[2 * i + 1 : 2 * i + 100] AS x FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
hit AS (SELECT r, i FROM (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY x) AS again FROM s) WHERE again),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY ALL),
kept AS (SELECT r, string_agg(h[2 * a + 1 : 2 * b], '' ORDER BY a) AS k FROM (SELECT d.r, d.h, coalesce(lag(s.b) OVER (PARTITION BY d.r ORDER BY s.a), 0) AS a, s.a AS b FROM d JOIN
  (SELECT r, a, b FROM span UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d) s ON s.r = d.r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, sum(b - a) AS n, count(*) AS c FROM span GROUP BY r) USING (r)"""
