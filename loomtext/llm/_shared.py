"""Helpers of the subpackage: reading tables, bounded Arrow batches, vectorised word hashing and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import measured, stored
from ..sources.ship import ship

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries don't have it
except (OSError, AttributeError):
    _LIBC = None

#: Most rows of an Arrow batch that Spark hands to Python. A batch of documents
#: then stays at some tens of MB even if every document is very long.
ARROW_ROWS = 512
#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before work in Python: send the package to the executors, and lower the
    session's Arrow batch size to ``rows`` if it is larger."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def id_bucket(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def trim() -> None:
    """Give freed memory back to the system; workers live long, and what they
    keep for later counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one
    longer value stays whole and makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        trim()


_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix64's end)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOW = 1 << 16
_POWERS, _INVERSES = (np.multiply.accumulate(np.full(_LOW, p, np.uint64)) for p in (_ODD, pow(_ODD, -1, 1 << 64)))


def _power(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The powers ``at`` + 1 of a number, from its first 65,536: no table of a
    text's length has to stay in memory."""
    high = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(at[-1] >> 16) if len(at) else 0, low[-1])]))
    return high[at >> 16] * low[at & (_LOW - 1)]


#: White space and ASCII punctuation, for words of letters and digits only.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = [not chr(c).isalnum() for c in range(128)]


def word_hashes(texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, in
    order, with A-Z lower-cased if ``lower``; and for each text where its words
    start (one entry more than texts). Null counts as empty.

    Works on the UTF-8 bytes of the whole array at once: a word's hash is a
    difference of prefix sums of byte codes times powers of an odd number."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ~space[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    start[inner] = word[inner]
    first = np.flatnonzero(start)
    last = word.copy()
    last[:-1] &= ~word[1:] | start[1:]
    end = np.flatnonzero(last)
    codes = _TABLE[_LOWER[raw] if lower else raw]
    codes *= _power(_POWERS, np.arange(len(raw), dtype=np.int32 if len(raw) < 1 << 31 else np.int64))
    np.cumsum(codes, out=codes)
    total = codes[end] - np.where(first > 0, codes[first - 1], np.uint64(0))
    total *= _power(_INVERSES, first)
    total ^= (end - first + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(total), np.searchsorted(first, offsets)


def shingles(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` following words, and for each shingle its text. A
    text of fewer words, but at least one, has its whole as its only shingle."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - starts[owner]
    room = counts[owner] - at
    keep = (room >= width) | ((at == 0) & (room > 0))
    base = np.flatnonzero(keep)
    value = np.zeros(len(base), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        piece = np.where(room[base] > k, padded[base + k], np.uint64(0))
        value = mix(value * np.uint64(_ODD) + piece)
    return value, owner[base]


#: Most ids that are broadcast to thin a table; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def thinned(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` semi- or anti-joined with the stored, distinct ``ids(doc_id)``:
    broadcast after counting if they are few, so that texts aren't shuffled."""
    few = ids.count() <= BROADCAST_IDS
    out = df.join(F.broadcast(ids) if few else ids, "doc_id", how)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def by_groups(df: DataFrame, keys: list[str], work, schema: str, partitions: int | None = None, together: tuple[int, int] = (1, 1)) -> DataFrame:
    """Deal ``df`` out by ``keys`` and give ``work`` one pyarrow table for each
    group, whole; it returns a table of ``schema`` or None. Groups follow each
    other in a sorted stream, so only one group is held at a time, or, for work
    that takes several at once, whole groups until these are ``together`` rows
    or bytes."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                group = pa.Table.from_batches(held)
                held.clear()
                out = work(group)
                large = group.nbytes > 1 << 20
                del group
                if large:
                    trim()
                if out is not None and out.num_rows:
                    yield from out.to_batches()

        last, rows, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in names:
                col = batch.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= col[1:] != col[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in names)
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            ended = last is not None and first != last
            for a, b in zip(cuts, cuts[1:]):
                if ended and (rows >= together[0] or size >= together[1]):
                    yield from done()
                    rows = size = 0
                part = batch.slice(a, b - a)
                held.append(part)
                rows, size, ended = rows + b - a, size + part.nbytes, True
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in names)
        yield from done()

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(run, schema)


def components(edges: DataFrame, tag: str = "cc", most: int = 40) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``node, root`` for
    each node of an edge, root being the smallest node reachable.

    Alternates large-star and small-star steps; every step is written to the
    shared folder, so lineage stays short and lost executors cost one step. A
    node's neighbours are never gathered in a list: stars are joins with the
    grouped minimum, so that a hub is aggregated map-side."""
    e = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        tag,
    )
    def shape(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = shape(e)
    for _ in range(most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        e = stored(small, tag)
        now = shape(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
