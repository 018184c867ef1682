"""Near-duplicate passages across documents by compact windows.

A text is its sequence of five-word shingles. Under each of ``HASHES`` hash
functions the Cartesian tree of the shingles' hashes (each one's nearest
smaller neighbours) groups all subsequences that have the same minimum: one
compact window (l, c, r) stands for every subsequence that begins in l..c and
ends in c..r. Only windows with room for ``LEAST`` shingles (passages of
``WORDS`` words) are kept, about 2 / ``LEAST`` per word. Of a window only the
place c of its minimum is used from then on: l and r tell which windows have room,
and aren't intersected across hash functions, so one minimum that is shared under
one function makes a candidate, and verification does the rest.

Two stretches of ``LEAST`` shingles are near duplicates if ``NEEDED`` places of
either stand in the other, which for distinct shingles is a Jaccard similarity
of ``SIMILARITY``. A place of a document is repeated if it lies in a stretch
(between its first and last shared place) that is a near duplicate of one
stretch of an earlier document, contiguous there too.

Windows of one minimum are joined with the first of them in the corpus (the
smallest document, then place), so a passage that very many documents share
costs a row each and not a pair each. Each joined pair of windows is verified
on the two stretches around its own two minima: place by place first, then, if
that doesn't reach the window's minimum, every stretch of one against every
stretch of the other, so that words put in, taken out or moved are found too.
The places that are found repeated are joined to spans per document. A
window whose minimum isn't found so is compared with all windows of its minimum
in smaller documents, those of equal surroundings once: an index of the
surroundings' shingles, rarest first, gives every one that can be near, so a
line that recurs in many surroundings costs no pairs. What is left out is a
pair of stretches that shares no minimum under any hash function (less than one
in a hundred at ``SIMILARITY``), and a place that is repeated only together
with a found passage of which it holds the minimum under none.

Every occurrence but the corpus's first is reported.

Defined cases: null, empty and short texts have no passage; very long texts are
read whole; of equal minima the leftmost counts; repetition inside one document
is not reported, nor between rows of one id; rows of one id with different
texts are searched one by one, and spans belong to the text they are found in;
rows of a null id are left alone; an empty table gives an empty result; extra
columns are left alone, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import done_with
from ._shared import BROADCAST_IDS, NOT_WORD, by_groups, measured, mix, shingles, slices, small_batches, stored, table, thinned, word_hashes
from .suffixlevels import freeing

WORDS, WIDTH, SIMILARITY = 50, 5, 0.8
LEAST = WORDS - WIDTH + 1
HASHES = 3
#: Documents are verified together until they hold so many rows or bytes.
TOGETHER = 64, 4 << 20
#: Minima are compared again together until their windows are so many rows or bytes.
MINIMA = 4096, 2 << 20
#: Places around a minimum that stretches with it can reach.
SPAN = 2 * LEAST - 1
#: Shingles of a stretch that must agree: m / (2 LEAST - m) >= SIMILARITY.
NEEDED = int(np.ceil(2 * LEAST * SIMILARITY / (1 + SIMILARITY) - 1e-9))


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in order, and where each text's begin. Texts of
    fewer than WIDTH words have one or none."""
    words, starts = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")), space=NOT_WORD)
    value, owner = shingles(words, starts, WIDTH)
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def nearest_smaller(h: np.ndarray, bound: np.ndarray, ties: bool) -> np.ndarray:
    """For each place the nearest one to the left with a smaller value (with
    ties: or an equal one), or ``bound - 1``. Places jump along the pointers
    found so far, all at once, which takes few rounds."""
    at = np.arange(len(h)) - 1
    active = np.arange(len(h))
    while len(active):
        j = at[active]
        inside = j >= bound[active]
        stop = ~inside | ((h[j] <= h[active]) if ties else (h[j] < h[active]))
        active = active[~stop]
        at[active] = at[at[active]]
    return np.maximum(at, bound - 1)


def _least_places(h: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The places that are the (leftmost) minimum of some ``least`` following
    values of one text, by minima from the borders of blocks of that length."""
    n = len(h)
    if n < least:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 20) - 1)
    packed = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    blocks = packed.reshape(-1, least)
    until = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    begin = np.arange(n - least + 1)
    least_of = np.minimum(since[begin], until[begin + least - 1])
    place = begin + ((least_of & low).astype(np.int64) - begin) % (1 << 20)
    last = np.repeat(starts[1:], np.diff(starts))[begin]
    place = place[begin + least <= last]
    return place[np.flatnonzero(np.diff(place, prepend=-1))] if len(place) else place


def compact_windows(value: np.ndarray, starts: np.ndarray, seed: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, l, c, r (places in ``value``) of the windows of ``least`` or more.

    Their minima are found first. All places above one of these in the
    Cartesian tree have wider windows and so are among them: the tree of these
    alone gives their l and r."""
    h = mix(value ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    c = _least_places(h, starts, least)
    text = np.searchsorted(starts, c, side="right") - 1
    edge = np.searchsorted(c, starts)
    first, last = edge[:-1][text], edge[1:][text]
    low, n = h[c], len(c)
    left = nearest_smaller(low, first, True)
    right = n - 1 - nearest_smaller(low[::-1], n - last[::-1], False)[::-1]
    around = np.r_[c, 0]
    begin = np.where(left >= first, around[left] + 1, starts[:-1][text])
    end = np.where(right < last, around[np.minimum(right, n)] - 1, starts[1:][text] - 1)
    return low, begin, c, end


def _windows(docs: DataFrame) -> DataFrame:
    """``key, doc_id, ver, at``: the minimum and its place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, starts = _sequence(batch.column("text"))
            ids, vers = batch.column("doc_id").to_numpy(), batch.column("ver").to_numpy()
            for seed in range(HASHES):
                h, _, c, _ = compact_windows(value, starts, seed)
                doc = np.searchsorted(starts, c, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(h + np.uint64(seed)).view(np.int64)), pa.array(ids[doc]), pa.array(vers[doc]), pa.array((c - starts[doc]).astype(np.int32))], names=["key", "doc_id", "ver", "at"]
                )

    return docs.mapInArrow(work, "key bigint, doc_id bigint, ver int, at int")


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of the intervals [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.r_[new[1:] - 1, len(b) - 1]].tolist()))


def _around(flat: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, SPAN) places of ``flat`` around ``at``, and which are in lo..hi."""
    place = at[:, None] + np.arange(1 - LEAST, LEAST)
    ok = (place >= lo[:, None]) & (place < hi[:, None])
    return flat[np.clip(place, 0, len(flat) - 1)], ok


def _sums(x: np.ndarray, axis: int, n: int = LEAST) -> np.ndarray:
    """Sums of ``n`` (at most 255) following entries along ``axis`` of booleans,
    put together from sums of 1, 2, 4, ... entries. These are taken of the whole
    array as one row; where they run over an end of ``axis`` they are left out."""
    power, step, width, at = np.ascontiguousarray(x).view(np.uint8).ravel(), int(np.prod(x.shape[axis + 1 :])), 1, 0
    total, size = np.zeros(x.size, np.uint8), max(0, x.size - (n - 1) * step)
    out = total[:size]
    while width <= n:
        if n & width:
            out += power[at * step : at * step + size]
            at += width
        width *= 2
        if width <= n:
            power = power[: len(power) - width // 2 * step] + power[width // 2 * step :]
    return total.reshape(x.shape)[(slice(None),) * axis + (slice(0, max(0, x.shape[axis] - n + 1)),)]


def _reach(shared: np.ndarray, good: np.ndarray) -> np.ndarray:
    """(n, SPAN): the places between the first and last ``shared`` one of the
    stretches that are ``good`` (n, LEAST), given by their first place."""
    place = np.arange(SPAN)
    after = np.minimum.accumulate(np.where(shared, place, SPAN)[:, ::-1], axis=1)[:, ::-1]
    before = np.maximum.accumulate(np.where(shared, place, -1), axis=1)
    row, i = np.nonzero(good)
    cells = len(shared) * (SPAN + 1)
    edge = np.bincount(row * (SPAN + 1) + after[row, i], minlength=cells) - np.bincount(row * (SPAN + 1) + before[row, i + LEAST - 1] + 1, minlength=cells)
    return np.cumsum(edge.reshape(-1, SPAN + 1), axis=1)[:, :SPAN] > 0


def aligned(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, needed: int = NEEDED) -> np.ndarray:
    """(n, SPAN): repeated places of ``a`` in ``b``, place against place."""
    valid = in_a & in_b
    same = (a == b) & valid
    good = (_sums(same, 1) >= needed) & (_sums(valid, 1) == LEAST)
    out = np.zeros(a.shape, bool)
    some = good.any(1)
    out[some] = _reach(same[some], good[some])
    return out


def unaligned(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, needed: int = NEEDED, wanted: np.ndarray | None = None) -> np.ndarray:
    """(n, SPAN): repeated places of ``a`` in ``b``, any stretch of one against
    any of the other. With ``wanted`` places of ``a``, none where none of these
    lies in a stretch that is a near duplicate; that enough of ``a`` stands in
    ``b`` is known then."""
    out = np.zeros(a.shape, bool)
    for k in range(0, len(a), 32):
        part = slice(k, k + 32)
        match = a[part][:, :, None] == b[part][:, None, :]
        for ok in (in_a[part][:, :, None], in_b[part][:, None, :]):
            if not ok.all():
                match &= ok
        some = match.any(1).sum(1) >= needed
        if wanted is None:
            some &= match.any(2).sum(1) >= needed
        some = np.flatnonzero(some)
        if not len(some):
            continue
        match = match[some]
        there, here = _sums(match, 2) > 0, _sums(match, 1) > 0  # (place, stretch of b), (stretch of a, place)
        good = (_sums(there, 1) >= needed) & (_sums(here, 2) >= needed)
        good &= (_sums(in_a[part][some], 1) == LEAST)[:, :, None] & (_sums(in_b[part][some], 1) == LEAST)[:, None, :]
        if wanted is not None:
            good &= (good.any(2) & (_sums(wanted[part][some], 1) > 0)).any(1)[:, None, None]
        # stretches of b that share the same places of a and are near the same stretches of it count once
        new = good.any(1)
        new[:, 1:] &= (there[:, :, 1:] != there[:, :, :-1]).any(1) | (good[:, :, 1:] != good[:, :, :-1]).any(1)
        row, x = np.nonzero(new)
        if len(row):
            found = _reach(there[row, :, x], good[row, :, x])
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[k + some[row[first]]] = np.logical_or.reduceat(found, first, axis=0)
    return out


def _stretches(there: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of sources that windows with these minima can reach, ``of``
    telling, ascending, whose each is: source, first place and end of each
    stretch; and in which stretch each minimum is."""
    order = np.lexsort((there, of))
    at, of = there[order], of[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (np.maximum(at[1:] - LEAST + 1, 0) > at[:-1] + LEAST)])
    stretch = np.empty(len(at), np.int64)
    stretch[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(at)]))
    return of[new], np.maximum(at[new] - LEAST + 1, 0), at[np.r_[new[1:] - 1, len(at) - 1]] + LEAST, stretch


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a source's shingles that a pair needs."""
    names = ["doc_id", "ver", "source_id", "here", "there", "keys"]
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("there").value_lengths().to_numpy()
        of, begin, end, _ = _stretches(batch.column("there").flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size))
        cuts, parts = np.searchsorted(of, np.arange(len(size) + 1)).tolist(), []
        begin, end = (4 * begin).tolist(), (4 * end).tolist()
        for k, raw in enumerate(batch.column("shingles").to_pylist()):
            parts.append(b"".join([raw[begin[i] : end[i]] for i in range(cuts[k], cuts[k + 1])]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parts, pa.binary())], names=[*names, "other"])


_RANGE = "doc_id bigint, ver int, source_id bigint, a bigint, b bigint"
_NONE = np.iinfo(np.int64).max


def _verified(group: pa.Table) -> pa.Table | None:
    """For each document of ``group`` the places found, each with a source of
    it; and its windows of minima that others share, with a mark of the
    shingles around and, if the minimum's place isn't found, which places
    aren't."""
    doc, ver = group.column("doc_id").to_numpy(), group.column("ver").to_numpy()
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1])])
    texts = [np.frombuffer(x, np.uint32) for x in group.column("shingles").take(pa.array(head)).to_pylist()]
    own, base = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    text_of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(doc)]))  # of each row
    source = np.full(len(own), _NONE)
    lists = {c: group.column(c).combine_chunks() for c in ("here", "there", "keys")}
    size = lists["here"].value_lengths().to_numpy()
    text_of, of = np.repeat(text_of, size), np.repeat(group.column("source_id").to_numpy(), size)
    here, at, key = lists["here"].flatten().to_numpy() + base[text_of], lists["there"].flatten().to_numpy().astype(np.int64), lists["keys"].flatten()
    # the stretches of all sources, one after the other, and the windows' places in them
    row = np.repeat(np.arange(len(size)), size)
    raw = group.column("other").to_pylist()
    flat, begins = np.frombuffer(b"".join(raw), np.uint32), np.cumsum([0, *map(len, raw)]) // 4
    of_part, start, end, stretch = _stretches(at, row)
    length = end - start
    where = np.cumsum(length) - length
    where += (begins[:-1] - where[np.searchsorted(of_part, np.arange(len(size)))])[of_part]  # in ``flat``
    lo = where[stretch]
    there, hi = lo + at - start[stretch], np.minimum(lo + length[stretch], begins[row + 1])
    reach = np.arange(1 - LEAST, LEAST)
    first, last = np.maximum(here - LEAST + 1, base[text_of]), np.minimum(here + LEAST, base[text_of + 1])
    # first a few windows, as one finds the places of its neighbours too
    for compare, every in ((aligned, 8), (aligned, 1), (unaligned, 4), (unaligned, 1)):
        left = source == _NONE
        if compare is aligned:  # windows with a place left around them
            n_left = np.concatenate([[0], np.cumsum(left)])
            todo = np.flatnonzero(n_left[last] > n_left[first])[every // 2 :: every]
        else:
            todo = np.flatnonzero(left[here])[every // 2 :: every]
        for k in range(0, len(todo), 2048):
            some = todo[k : k + 2048]
            found = compare(*_around(own, here[some], first[some], last[some]), *_around(flat, there[some], lo[some], hi[some]))
            row, place = np.nonzero(found)
            np.minimum.at(source, here[some[row]] + reach[place], of[some[row]])
    shared = key.is_valid().to_numpy(zero_copy_only=False)
    at, text_of, first, last, key = here[shared], text_of[shared], first[shared], last[shared], key.drop_null().to_numpy()
    left = source == _NONE
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own.astype(np.uint64)))])
    mark = mix(sums[last] - sums[first]) ^ (last - first).astype(np.uint64)
    bits = np.full(len(at), None, object)
    for k in np.flatnonzero(left[at]):
        bits[k] = np.packbits(left[first[k] : last[k]]).tobytes()
    doc, ver = doc[head], ver[head]
    windows = {"doc_id": doc[text_of], "ver": ver[text_of], "key": key, "at": (at - base[text_of]).astype(np.int32), "mark": mark.view(np.int64), "left": pa.array(bits, pa.binary())}
    # the found places in ranges of one text and source
    text = np.repeat(np.arange(len(texts)), np.diff(base))
    cut = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (text[1:] != text[:-1])])
    until = np.r_[cut[1:], len(own)]
    found = source[cut] < _NONE
    cut, until = cut[found], until[found]
    ranges = {"doc_id": doc[text[cut]], "ver": ver[text[cut]], "source_id": source[cut], "a": cut - base[text[cut]], "b": until - base[text[cut]]}
    return pa.concat_tables([pa.table(ranges), pa.table(windows)], promote_options="default").select(["doc_id", "ver", "source_id", "a", "b", "key", "at", "mark", "left"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles around each window of a document."""
    for batch in batches:
        for doc, ver, windows, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ver").to_pylist(), batch.column("windows"), batch.column("shingles").to_pylist()):
            s, w = np.frombuffer(raw, np.uint32), windows.values
            at = w.field("at").to_numpy().astype(np.int64)
            lo = np.maximum(at - LEAST + 1, 0)
            cut = [s[i:j].tobytes() for i, j in zip(lo, at + LEAST)]
            yield pa.RecordBatch.from_arrays(
                [w.field("key"), pa.array(np.full(len(w), doc)), pa.array(np.full(len(w), ver), pa.int32()), pa.array(lo), w.field("left"), pa.array(cut, pa.binary())], names=["key", "doc_id", "ver", "lo", "left", "around"]
            )


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def _padded(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, SPAN) entries of ``flat`` from ``start`` on, and which are there."""
    place = np.arange(SPAN)
    ok = place < size[:, None]
    return flat[np.minimum(start[:, None] + place, len(flat) - 1)], ok


def _reached(shared: np.ndarray, size: np.ndarray, needed: int) -> np.ndarray:
    """Which places (columns) lie in a stretch of LEAST, of ``size`` places,
    with ``needed`` shared."""
    good = (_sums(shared, 1) >= needed) & (np.arange(LEAST, SPAN + 1) <= size[:, None])
    wide = np.zeros((len(shared), SPAN + LEAST - 1), bool)
    wide[:, LEAST - 1 : SPAN] = good
    return _sums(wide, 1) > 0


@dataclass
class _Goal:
    """A window that is compared again: its ``open`` places, the sources to come,
    those at hand with the places they reach, and which of these are to be tried."""

    window: int
    open: np.ndarray
    more: Iterator[tuple[np.ndarray, np.ndarray]]
    part: np.ndarray | None = None
    reach: np.ndarray | None = None
    todo: np.ndarray | tuple = ()
    batch: int = 1


def rejoined(key: np.ndarray, docs: np.ndarray, los: np.ndarray, goal: np.ndarray, flat: np.ndarray, ends: np.ndarray, left: np.ndarray, needed: int = NEEDED) -> list[tuple[int, int, int, int]]:
    """``window, source_id, a, b`` of the places that are repeated in a source
    of a smaller document and the same ``key``. Windows lie by key; those that are
    no ``goal`` are sources. ``flat`` has the shingles around each window, up to
    ``ends``, and ``left`` the wanted places of these."""
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes
    number_of = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    _, rank = np.unique(docs, return_inverse=True)
    rank = number_of * (len(docs) + 1) + rank
    order, goals = np.flatnonzero(~goal), np.flatnonzero(goal)
    order = order[np.argsort(rank[order], kind="stable")]
    if not len(order) or not len(goals):
        return []
    high = np.uint64(32)
    both = np.repeat(np.arange(len(order), dtype=np.uint64) << high, sizes[order]) | flat[_ranges(begins[order], sizes[order])]
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]]  # the distinct shingles of each source
    starts = np.searchsorted(both, np.arange(len(order) + 1, dtype=np.uint64) << high)
    source_of = (both >> high).astype(np.int32)
    value = (number_of[order].astype(np.uint64) << high)[source_of] | both.astype(np.uint32)
    by_value = np.argsort(value, kind="stable")
    value = value[by_value]
    new = np.r_[True, value[1:] != value[:-1]]
    shingle, first = value[new], np.flatnonzero(new)
    count = np.diff(first, append=len(value))
    owner = source_of[by_value]
    number = np.empty(len(value), np.int32)
    number[by_value] = np.cumsum(new, dtype=np.int32) - 1

    # places whose shingles stand in a smaller document; no others can be a repeated place's end
    smaller = np.searchsorted(rank[order], rank[goals], side="left")
    lowest = np.searchsorted(rank[order], number_of[goals] * (len(docs) + 1), side="left")  # the key's first source
    # most goals end here: too little around them stands in smaller documents at all
    live = []
    for a in range(0, len(goals), 1024):
        y = goals[a : a + 1024]
        size, place = sizes[y], _ranges(begins[y], sizes[y])
        wanted = flat[place] | np.repeat(number_of[y].astype(np.uint64) << high, size)
        at = np.minimum(np.searchsorted(shingle, wanted), len(shingle) - 1)
        there = (shingle[at] == wanted) & (owner[first[at]] < np.repeat(smaller[a : a + 1024], size))
        inside = np.arange(SPAN) < size[:, None]
        known, ids, open_ = np.zeros(inside.shape, bool), np.zeros(inside.shape, np.int32), np.zeros(inside.shape, bool)
        known[inside], ids[inside], open_[inside] = there, at, there & left[place]
        open_ &= _reached(known, size, needed)
        live += [(a + int(k), known[k], ids[k], open_[k]) for k in np.flatnonzero(open_.any(1))]

    column, mark = np.zeros(len(shingle), np.uint8), np.zeros(len(order), bool)

    def candidates(k: int, known: np.ndarray, ids: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sources that share enough places with a goal, in their order, and
        which; 1,024 sources are looked at at a time while a place is open."""
        own, place, times = np.unique(ids[known], return_inverse=True, return_counts=True)
        through = np.unique(ids[open_])
        if count[through].sum() > 512:
            # of a stretch's known places so many, the rarest, can't all be missing; a
            # shingle that stands in it repeatedly counts at each of its places
            cost = np.where(known, count[ids], len(value) + 1)
            enough, some = _sums(np.stack([known, open_]), 1).astype(np.int64)
            some = np.flatnonzero((enough >= needed) & (some > 0))
            order_in = np.argsort(sliding_window_view(cost, LEAST)[some], axis=1, kind="stable")[:, : LEAST - needed + 1]
            rare = np.unique(ids[(some[:, None] + order_in)[np.arange(LEAST - needed + 1) < (enough[some] - needed + 1)[:, None]]])
            through = min(rare, through, key=lambda x: count[x].sum())
        found = owner[_ranges(first[through], count[through])]
        mark[found] = True
        maybe = lowest[k] + np.flatnonzero(mark[lowest[k] : smaller[k]])
        mark[found] = False
        cell, weight = np.zeros(SPAN, np.int64), np.concatenate([[0], times])
        cell[known] = place + 1
        for a in range(0, len(maybe), 1024):
            if not open_.any():
                return
            part = maybe[a : a + 1024]
            size = starts[part + 1] - starts[part]
            column[own] = np.arange(1, len(own) + 1)
            cells = column[number[_ranges(starts[part], size)]]
            column[own] = 0
            shares = np.flatnonzero(cells)
            row, cells = np.repeat(np.arange(len(part)), size)[shares], cells[shares]
            enough = np.bincount(row, weights=weight[cells], minlength=len(part)) >= needed
            keep = enough[row]
            has = np.zeros((int(enough.sum()), len(own) + 1), bool)
            has[(np.cumsum(enough) - 1)[row[keep]], cells[keep]] = True
            yield part[enough], has[:, cell]

    out, waiting, active = [], iter(live), []
    while True:
        # some goals at a time, each with its sources in their order
        for k, known, ids, open_ in itertools.islice(waiting, 32 - len(active)):
            active.append(_Goal(goals[k], open_, candidates(k, known, ids, open_)))
        if not active:
            return out
        fresh = [x for x in active if not len(x.todo)]
        for x in fresh:
            x.part, x.reach = next(x.more, (None, None))
        active, fresh = ([x for x in y if x.part is not None] for y in (active, fresh))
        if fresh:
            shared = np.concatenate([x.reach for x in fresh])
            shared &= _reached(shared, np.repeat(sizes[[x.window for x in fresh]], [len(x.part) for x in fresh]), needed)
            for x, reach in zip(fresh, np.split(shared, np.cumsum([len(x.part) for x in fresh])[:-1])):
                x.reach, x.todo, x.batch = reach, np.flatnonzero((reach & x.open).any(1)), 1
        turns = [x for x in active if len(x.todo)]
        if not turns:
            continue
        few = [x.part[x.todo[: x.batch]] for x in turns]
        n = [len(f) for f in few]
        y, theirs = np.repeat([x.window for x in turns], n), order[np.concatenate(few)]
        hits = unaligned(*_padded(flat, begins[y], sizes[y]), *_padded(flat, begins[theirs], sizes[theirs]), needed=needed, wanted=np.repeat([x.open for x in turns], n, axis=0))
        useful, i = hits.any(1), 0
        for x, m in zip(turns, n):
            x.todo, x.batch = x.todo[m:], min(32, 4 * x.batch)
            for h in i + np.flatnonzero(useful[i : i + m]):
                if (hits[h] & x.open).any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hits[h].astype(np.int8), 0]))
                    out += [(int(x.window), int(docs[theirs[h]]), int(los[x.window] + a), int(los[x.window] + b)) for a, b in zip(edge[::2], edge[1::2])]
                    x.open &= ~hits[h]
            if useful[i : i + m].any():
                x.todo = x.todo[(x.reach[x.todo] & x.open).any(1)]
            i += m


def _rejoined(group: pa.Table) -> pa.Table | None:
    docs, left = group.column("doc_id").to_numpy(), group.column("left").combine_chunks()
    goal = left.is_valid().to_numpy(zero_copy_only=False)
    around = group.column("around").to_pylist()
    sizes = np.array([len(x) // 4 for x in around])
    wanted = np.zeros(sizes.sum(), bool)
    bits = [x for x in left.to_pylist() if x is not None]
    if not bits or len(bits) == len(goal):
        return None
    held = np.array([8 * len(x) for x in bits])
    ends = np.cumsum(sizes)
    wanted[_ranges((ends - sizes)[goal], sizes[goal])] = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8))[_ranges(np.cumsum(held) - held, sizes[goal])]
    found = rejoined(group.column("key").to_numpy(), docs, group.column("lo").to_numpy(), goal, np.frombuffer(b"".join(around), np.uint32), ends, wanted)
    if not found:
        return None
    window, source, a, b = (np.array(x, np.int64) for x in zip(*found))
    return pa.table({"doc_id": docs[window], "ver": group.column("ver").to_numpy()[window], "source_id": source, "a": a, "b": b})


def _spans(group: pa.Table) -> pa.Table | None:
    """Spans of one text, in words, each with its smallest source."""
    a, b, sources = (group.column(c).to_numpy() for c in ("a", "b", "source_id"))
    source = np.full(b.max(), _NONE)
    for i, j, k in zip(a, b, sources):
        source[i:j] = np.minimum(source[i:j], k)
    found = source < _NONE
    edge = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
    a, b = edge[::2], edge[1::2]
    spans = [(i, j) for i, j in zip(a, b) if j - i >= NEEDED]
    if not spans:
        return None
    # spans whose words meet are one
    merged = _merged(np.array([i for i, _ in spans]), np.array([j + WIDTH - 1 for _, j in spans]))
    doc = group.column("doc_id")[0].as_py()
    return pa.table(
        {"doc_id": pa.array([doc] * len(merged), pa.int64()), "ver": pa.array([group.column("ver")[0].as_py()] * len(merged), pa.int32()), "source_id": pa.array([int(source[i : j - WIDTH + 1].min()) for i, j in merged], pa.int64()), "start_word": pa.array([i for i, _ in merged], pa.int64()), "end_word": pa.array([j for _, j in merged], pa.int64())}
    )


def _versions(docs: DataFrame, name: str = "ver") -> DataFrame:
    """``docs`` with a column that tells the texts of a repeated id apart: 0 for
    an id of one row, else a hash of the text."""
    twice = stored(docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    few = twice.count()
    if not few:
        return docs.withColumn(name, F.lit(0))
    mark = twice.select(F.col("doc_id").alias(f"{name}id"))
    joined = docs.join(F.broadcast(mark) if few <= BROADCAST_IDS else mark, F.col("doc_id") == F.col(f"{name}id"), "left")
    return joined.withColumn(name, F.when(F.col(f"{name}id").isNull(), F.lit(0)).otherwise(F.hash(F.col("text").cast("string")))).drop(f"{name}id")


def _found(docs: DataFrame) -> DataFrame:
    """``doc_id, ver, source_id, start_word, end_word`` of ``docs(doc_id, ver, text)``.
    Called where shuffle files of a table go once it is written (``freeing``)."""
    windows = stored(_windows(docs), "windows")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "ver", "at")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first.doc_id < last")
    # stored, so that a hot key's side of the join below is a plain shuffle, which adaptive execution can split
    first = stored(first.select("key", F.col("first.doc_id").alias("source_id"), F.col("first.ver").alias("source_ver"), F.col("first.at").alias("there"), (F.col("n") > 2).alias("more")), "first")
    pairs = (
        windows.join(first, "key")
        .where("doc_id <> source_id")
        .groupBy("doc_id", "ver", "source_id", "source_ver")
        .agg(F.collect_list(F.struct("at", "there", F.when(F.col("more"), F.col("key")).alias("key"))).alias("x"))  # at most the windows of one document
        .select("doc_id", "ver", "source_id", "source_ver", F.col("x.at").alias("here"), F.col("x.there").alias("there"), F.col("x.key").alias("keys"))
    )
    pairs = stored(pairs, "pairs")
    for table_ in (windows, first):
        done_with(table_)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, starts = _sequence(batch.column("text"))
            low = value.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ver"), pa.array([low[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["doc_id", "ver", "shingles"])

    ids = stored(pairs.select("doc_id").unionByName(pairs.select(F.col("source_id").alias("doc_id"))).distinct(), "ids")
    shingled = thinned(docs, ids, "left_semi").mapInArrow(work, "doc_id bigint, ver int, shingles binary")
    shingled = stored(shingled.dropDuplicates(["doc_id", "ver"]), "shingled")  # repeated rows are equal
    cut = pairs.join(shingled.withColumnsRenamed({"doc_id": "source_id", "ver": "source_ver"}), ["source_id", "source_ver"])
    cut = cut.mapInArrow(_cut, "doc_id bigint, ver int, source_id bigint, here array<int>, there array<int>, keys array<bigint>, other binary")
    both = cut.join(shingled, ["doc_id", "ver"])
    seen = stored(by_groups(both, ["doc_id", "ver"], _verified, _RANGE + ", key bigint, at int, mark bigint, left binary", together=TOGETHER), "seen")
    done_with(pairs)

    # windows whose minimum isn't found, and the first of each surroundings in smaller documents
    rest = seen.where("at is not null").select("key", "doc_id", "ver", "at", "mark", "left")
    goals = rest.where("left is not null")
    last = goals.groupBy("key").agg(F.max("doc_id").alias("last"))
    others = rest.join(last, "key").where("doc_id < last").groupBy("key", "mark").agg(F.min(F.struct("doc_id", "ver", "at")).alias("x"))
    others = stored(others.select("key", "x.doc_id", "x.ver", "x.at", F.lit(None).cast("binary").alias("left")), "others")
    low = others.groupBy("key").agg(F.min("doc_id").alias("low"))
    need = others.unionByName(goals.join(low, "key").where("doc_id > low").select("key", "doc_id", "ver", "at", "left"))
    need = stored(need.groupBy("doc_id", "ver").agg(F.collect_list(F.struct("key", "at", "left")).alias("windows")), "need")  # at most twice the windows of one document
    # planned by the caller: not broadcast by the size of its file
    around = need.hint("merge").join(shingled, ["doc_id", "ver"]).mapInArrow(_surroundings, "key bigint, doc_id bigint, ver int, lo bigint, left binary, around binary")
    more = by_groups(around, ["key"], _rejoined, _RANGE, together=MINIMA)
    ranges = seen.where("at is null").select("doc_id", "ver", "source_id", "a", "b").unionByName(more)
    return by_groups(ranges, ["doc_id", "ver"], _spans, "doc_id bigint, ver int, source_id bigint, start_word bigint, end_word bigint")


def passages(docs: DataFrame) -> DataFrame:
    """``doc_id, source_id, start_word, end_word`` of the repeated passages of
    ``docs(doc_id, text)``; words are runs of letters, digits and characters
    beyond ASCII, counted from 0."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with measured(docs.sparkSession), freeing(docs.sparkSession):
        return _found(_versions(docs)).drop("ver")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; what stands between a cut and
    the next word goes with it."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    word = ~NOT_WORD[raw]
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        if a < len(start):
            keep[start[a] : start[b] if b < len(start) else len(raw)] = False
    return raw[keep].tobytes().decode("utf-8")


def query(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).withColumn("n_words", F.col("end_word") - F.col("start_word"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeated passage out of all documents but the first that has
    it. A document of which no word is left goes; ``n_chars``, if there,
    follows. Rows with a null id or text, empty and short texts stay as they
    are, as do extra columns; of rows of one id each is cut where its own text
    repeats another id's; very long texts are read whole; an empty table stays
    empty."""
    small_batches(spark)
    names = docs.columns
    ver, cuts = (next(f"{x}{k}" for k in range(len(names) + 1) if f"{x}{k}" not in names and f"{x}{k}id" not in names) for x in ("ver", "cuts"))
    marked = _versions(docs, ver)
    narrow = marked.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ver).alias("ver"), F.col("text").cast("string").alias("text"))
    with measured(spark), freeing(spark):
        spans = stored(_found(narrow), "spans")
    spans = stored(spans.groupBy("doc_id", F.col("ver").alias(ver)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts)), "spans")
    ids = stored(spans.select("doc_id").distinct(), "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s is not None and t is not None for t, s in zip(batch.column("text"), batch.column(cuts).to_pylist())]
            texts = [cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) if f else t for f, t, s in zip(found, batch.column("text").to_pylist(), batch.column(cuts).to_pylist())]
            keep = pa.array([not f or any(c.isalnum() for c in t) for f, t in zip(found, texts)], pa.bool_())
            out = []
            for name in names:
                f = batch.schema.field(name)
                if name == "text":
                    out.append(pa.array(texts, f.type))
                elif name == "n_chars" and pa.types.is_integer(f.type):
                    out.append(pa.array([len(t) if f_ else n for f_, t, n in zip(found, texts, batch.column(name).to_pylist())], f.type))
                else:
                    out.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(out, names=names).filter(keep)

    changed = thinned(marked, ids, "left_semi").join(spans.hint("merge"), ["doc_id", ver], "left").select(*[F.col(f"`{c}`") for c in names], cuts).mapInArrow(work, docs.schema)
    return thinned(docs, ids, "left_anti").unionByName(changed)
