"""Katz back-off scores of texts: bigrams over unigrams, Good-Turing discounts.

Counts r of 1 to ``K`` are discounted by Good-Turing's d_r, at either order; a
total (of a context, or of all words) counts one event more than was seen, so
that every distribution keeps some mass:

    P(w)     = d c(w) / (N + 1),            the rest for all unknown words
    P(w | v) = d c(v,w) / (c(v) + 1)        if (v, w) was seen in training
             = a(v) P(w)                    if not
    a(v)     = (1 - sum of P(w | v) over seen w) / (1 - sum of P(w) over seen w)

which sums to one for every context. Each text begins with a start mark, which
is a context only, and ends with an end mark, which is a token.

How it runs. Tasks hash words to 64 bits, count the distinct pairs of a slice,
and deal them out by word in packed arrays (a pair takes about nine bytes). The
task of a bucket of words knows c(w) and c(v,w) of its words; it leaves in a
table, partitioned in ``part``, for each document the numbers of its tokens by
class of count, for each context its partial counts (which make a(v)), and the
places where a document backs off in a context. A second pass knows the
discounts, joins contexts with back-offs, and adds up each document. The counts
of counts are a row for each bucket. Words and contexts that are very frequent
are found in a sample, counted exactly, sent to all tasks (a bounded list), and
their pairs are dealt out by the whole pair.

A document's sum of log(c(v) + 1) over contexts is that of log(c(w) + 1) over
tokens, start and end being as frequent, so that needs no join.

Defined cases: null and empty texts are an end mark; with no training text
every word is unknown and P is 1 for it; every row is scored alone, also if ids
repeat or are null; very long texts are scored whole; ties don't arise; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_groups, id_bucket, mix, slices, small_batches, stored, table, thinned, trim, word_hashes

K = 5
#: Bytes of text for each bucket of words and the least number of buckets; a
#: bucket is worked on in SHELVES, one after the other. Bytes of a slice whose
#: pairs are counted at once.
BUCKET_BYTES, BUCKETS, SHELVES, SLICE = 40_000_000, 24, 8, 4 << 20
#: Documents whose sums are added up by one task at a time.
TOGETHER = 100_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_LOW6 = np.uint64((1 << 48) - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each by planes of equal bytes, compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).reshape(-1).view(kind) if n else np.empty(0, kind) for kind, n, b in planes]


def _context(word: np.ndarray) -> np.ndarray:
    """A context is named by six bytes of its word's hash."""
    return mix(word) >> np.uint64(16)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context (six bytes) and text of every token, end marks included."""
    words, starts = word_hashes(texts)
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts) + 1)
    w = np.empty(len(words) + n, np.uint64)
    ends = starts[1:] + np.arange(n)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = words, END
    v = np.concatenate([[START], w[:-1]]) if len(w) else w.copy()
    v[1:][ends[:-1]] = START
    return w, _context(v), owner


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_0 (unused) to d_K from the counts of counts n_0 (unused) to n_K+1; 1
    where Good-Turing gives no discount between 0 and 1."""
    d = np.ones(K + 1)
    n = counts.astype(float)
    if n[1] > 0 and n[K + 1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1.0
    return d


def _bucket(w: np.ndarray, v: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    q = mix(w)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
        q = np.where(hot[at] == w, mix(w ^ mix(v)), q)
    return (q % np.uint64(n)).astype(np.int64)


def _deal(docs: DataFrame, hot, n: int) -> DataFrame:
    """``q, blob``: for each slice and bucket its documents, its distinct
    pairs with their training counts, and the documents of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value[0]
        for batch in slices(batches, "text", SLICE):
            w, v, owner = tokens(batch.column("text"))
            ids, learn = batch.column("doc_id").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False)
            order = np.argsort(w & ~np.uint64((1 << 20) - 1) | v >> np.uint64(28), kind="stable")
            w, v, owner = w[order], v[order], owner[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.r_[first, len(w)])
            trained = np.add.reduceat(learn[owner].astype(np.int64), first)
            pw, pv = w[first], v[first]
            q = _bucket(pw, pv, frequent, n * SHELVES)
            by = np.argsort(q, kind="stable")
            cut = np.searchsorted(q[by], np.arange(n * SHELVES + 1))
            blobs, names = [], []
            docs_of = owner.astype(np.uint32 if batch.num_rows > 65535 else np.uint16)
            for b in np.flatnonzero(np.diff(cut)):
                k = by[cut[b] : cut[b + 1]]
                flat = np.repeat(first[k] - np.r_[0, np.cumsum(times[k])[:-1]], times[k]) + np.arange(int(times[k].sum()))
                used, local = np.unique(docs_of[flat], return_inverse=True)
                blobs.append(pack(np.diff(ids[used], prepend=0), np.diff(pw[k], prepend=np.uint64(0)), _to_six(np.diff(pv[k], prepend=np.uint64(0))), trained[k].astype(np.uint32), times[k].astype(np.uint32), local.astype(np.uint32)))
                names.append(int(b))
            yield pa.RecordBatch.from_arrays([pa.array([x // SHELVES for x in names], pa.int32()), pa.array([x % SHELVES for x in names], pa.int32()), pa.array(blobs, pa.binary())], names=["q", "shelf", "blob"])

    return docs.select("doc_id", "text", "learn").mapInArrow(work, "q int, shelf int, blob binary")


def _to_six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw.view(np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _classes(c: np.ndarray) -> np.ndarray:
    """0 for unseen, r for 1 to K, K + 1 beyond."""
    return np.minimum(c, K + 1)


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    """The part in which a document's sums are added up."""
    return (mix(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _by_home(ids: np.ndarray, homes: int, kind: str, columns: list[np.ndarray]) -> list[tuple[int, str, bytes]]:
    home = _home(ids, homes)
    return [(int(p), kind, pack(ids[home == p], *[c[home == p] for c in columns])) for p in np.unique(home)]


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.string()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _counted(hot, parts: int, homes: int):
    """Of a bucket: rows ``part, kind, blob``."""

    def work(group: pa.Table) -> pa.Table:
        rows, held = [], []
        shelves = group.column("shelf").to_numpy()
        for k in np.unique(shelves):
            more, columns = shelf([group.column("blob")[int(i)].as_py() for i in np.flatnonzero(shelves == k)])
            rows += more
            held.append(columns)
            if sum(len(x[0]) for x in held) > TOGETHER:
                held = [_merged(held)]
                if len(held[0][0]) > 3 * TOGETHER:
                    rows += _by_home(held[0][0], homes, "documents", held[0][1:])
                    held = []
            trim()
        if held:
            merged = _merged(held)
            rows += _by_home(merged[0], homes, "documents", merged[1:])
        return _rows(rows)

    def shelf(blobs: list[bytes]) -> tuple[list[tuple[int, str, bytes]], list[np.ndarray]]:
        frequent, exact = hot.value
        ids, w, v, trained, times, docs = ([] for _ in range(6))
        base = 0
        for raw in blobs:
            a, b, c, d, e, f = unpack(raw)
            ids.append(np.cumsum(a)), w.append(np.cumsum(b, dtype=np.uint64)), v.append(np.cumsum(_six(c), dtype=np.uint64) & _LOW6), trained.append(d), times.append(e), docs.append(f.astype(np.int32) + np.int32(base))
            base += len(a)
        ids, w, v, trained, times, docs = map(np.concatenate, (ids, w, v, trained, times, docs))
        trained, times = trained.astype(np.int64), times.astype(np.int64)
        doc_ids, of = np.unique(ids, return_inverse=True)
        docs, n = of.astype(np.int32)[docs], len(doc_ids)
        # c(w): of this bucket's words, or the exact counts of the frequent
        words, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, trained, len(words)).astype(np.int64)
        place = np.minimum(np.searchsorted(frequent, words), max(0, len(frequent) - 1))
        is_hot = frequent[place] == words if len(frequent) else np.zeros(len(words), bool)
        unigrams = np.bincount(_classes(c[~is_hot]), minlength=K + 2)
        total = int(c[~is_hot].sum())
        c[is_hot] = exact[place[is_hot]]
        cw = c[at]
        # c(v, w)
        order = np.lexsort((v, at))
        new = np.ones(len(order), bool)
        new[1:] = (at[order][1:] != at[order][:-1]) | (v[order][1:] != v[order][:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        cvw = np.bincount(pair, trained).astype(np.int64)
        first = order[new]
        bigrams = np.bincount(_classes(cvw[cvw > 0]), minlength=K + 2)
        n6 = np.zeros(K + 2, np.int64)
        n6[: K + 1], n6[K + 1] = bigrams[: K + 1], (cvw == K + 1).sum()
        u6 = np.zeros(K + 2, np.int64)
        u6[: K + 1], u6[K + 1] = unigrams[: K + 1], (c[~is_hot] == K + 1).sum()
        seen_words = int((c[~is_hot] > 0).sum())
        rows = [(-1, "counts", pack(n6, u6, np.array([total, seen_words])))]
        # documents: tokens by class of count
        token = np.repeat(np.arange(len(w), dtype=np.int32), times)
        tw, tvw = cw[token], cvw[pair][token]
        seen = tvw > 0
        col = [np.bincount(docs, minlength=n), np.bincount(docs, tw > 0, n), np.bincount(docs, np.log10(tw + 1.0), n)]
        col += [np.bincount(docs[tvw == r], minlength=n) for r in range(1, K + 1)]
        many = tvw > K
        col.append(np.bincount(docs[many], np.log10(tvw[many]), n))
        back = ~seen
        del tvw
        col += [np.bincount(docs[back & (tw == r)], minlength=n) for r in range(K + 1)]
        many = back & (tw > K)
        col += [np.bincount(docs[many], np.log10(tw[many]), n), np.bincount(docs[many], minlength=n)]
        del tw, many, seen
        # contexts: partial counts that make a(v)
        pv, pc_, pw = v[first], cvw, cw[first]
        some = pc_ > 0
        ctx, which = np.unique(pv[some], return_inverse=True)
        pc_, pw, m = pc_[some], pw[some], len(ctx)
        stats = [np.bincount(which, pc_, m)] + [np.bincount(which[pc_ == r], minlength=m) for r in range(1, K + 1)] + [np.bincount(which[pc_ > K], pc_[pc_ > K], m)]
        stats += [np.bincount(which[pw == r], minlength=m) for r in range(1, K + 1)] + [np.bincount(which[pw > K], pw[pw > K], m)]
        part = (mix(ctx) % np.uint64(parts)).astype(np.int64)
        for p in np.unique(part):
            k = part == p
            rows.append((int(p), "contexts", pack(np.diff(ctx[k], prepend=np.uint64(0)), *[s[k].astype(np.uint32 if s[k].max(initial=0) < 1 << 32 else np.uint64) for s in stats])))
        # back-offs: context and document, those of frequent contexts apart
        bv, bd = v[token[back]], docs[back]
        if len(bv):
            order = np.lexsort((bd, bv))
            bv, bd = bv[order], bd[order]
            new = np.ones(len(bv), bool)
            new[1:] = (bv[1:] != bv[:-1]) | (bd[1:] != bd[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.r_[at, len(bv)])
            bv, bd = bv[at], bd[at]
            low = np.sort(_context(frequent))
            is_hot = low[np.minimum(np.searchsorted(low, bv), max(0, len(low) - 1))] == bv if len(low) else np.zeros(len(bv), bool)
            if is_hot.any():
                rows += _by_home(doc_ids[bd[is_hot]], homes, "frequent", [bv[is_hot], times[is_hot].astype(np.uint32)])
            bv, bd, times = bv[~is_hot], bd[~is_hot], times[~is_hot]
            part = (mix(bv) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                k = part == p
                rows.append((int(p), "backoffs", pack(np.diff(bv[k], prepend=np.uint64(0)), doc_ids[bd[k]], times[k].astype(np.uint32))))
        return rows, [doc_ids, *map(_compact, col)]

    return work


def _compact(column: np.ndarray) -> np.ndarray:
    """Whole numbers as such, which take less room."""
    return column.astype(np.int32) if column.max(initial=0) < 1 << 31 and (column == np.rint(column)).all() else column


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Ids and columns with the columns of equal ids added up."""
    name, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    return [name, *[_compact(np.bincount(at, np.concatenate([x[k] for x in held]), len(name))) for k in range(1, len(held[0]))]]


def _added(ids: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    name, at = np.unique(np.concatenate(ids), return_inverse=True)
    each = np.concatenate(sums)
    return [name], [np.stack([np.bincount(at, each[:, k], len(name)) for k in range(each.shape[1])], 1)]


def context_terms(stats: list[np.ndarray], d2: np.ndarray, d1: np.ndarray, total: int) -> np.ndarray:
    """log10 a(v) and log10(c(v) + 1) of contexts by their counts: c, then
    n_1..n_K and the sum beyond, of pairs and of the followers' own counts."""
    r = np.arange(1, K + 1)
    c = stats[0]
    kept = sum(d2[k] * k * stats[k] for k in r) + stats[K + 1]
    lower = (sum(d1[k] * k * stats[K + 1 + k] for k in r) + stats[2 * K + 2]) / (total + 1)
    return np.stack([np.log10((1 - kept / (c + 1)) / np.maximum(1 - lower, 1e-300)), np.log10(c + 1)])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a ``doc_id`` of their own for rows whose id is null or
    repeated, and these ids' ``doc_id, own``; None if there are none."""
    twice = stored(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs, None
    again = twice.where("doc_id is not null")
    several = thinned(docs, again, "left_semi").unionByName(docs.where("doc_id is null"))
    # stored, so that the numbers stay
    several = stored(several.withColumn("own", F.col("doc_id")).withColumn("doc_id", F.xxhash64(F.monotonically_increasing_id(), F.lit(41)).bitwiseOR(F.lit(1 << 62))), "several")
    single = thinned(docs.where("doc_id is not null"), again, "left_anti")
    return single.unionByName(several.drop("own")), several.select("doc_id", "own")


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every
    row of ``docs(doc_id, text)``, learning from those where ``learn`` is true."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    docs, names = _keyed(docs)
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(BUCKETS, math.ceil(size / BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(_frequent(docs, rows, n))
    homes = max(1, math.ceil(rows / TOGETHER))
    schema = "part int, kind string, blob binary"
    tables = stored(by_groups(_deal(docs, hot, n), ["q"], _counted(hot, n, homes), schema), "katz")
    n2, n1 = np.zeros(K + 2, np.int64), np.zeros(K + 2, np.int64)
    total = vocabulary = 0
    for (raw,) in tables.where("kind = 'counts'").select("blob").toLocalIterator():  # one small row a bucket
        a, b, t = unpack(bytes(raw))
        n2, n1, total, vocabulary = n2 + a, n1 + b, total + int(t[0]), vocabulary + int(t[1])
    exact = hot.value[1]
    total, vocabulary = total + int(exact.sum()), vocabulary + int((exact > 0).sum())
    n1 += np.array([0] + [int((exact == r).sum()) for r in range(1, K + 2)])
    d2, d1 = discounts(n2), discounts(n1)
    # n_r d_r r is the mass of the words seen r times; the rest is the unknown's
    seen_mass = sum(d1[r] * r * n1[r] for r in range(1, K + 1)) + (total - sum(r * n1[r] for r in range(1, K + 1)))
    unknown = 1 - seen_mass / (total + 1)
    frequent = np.sort(_context(hot.value[0]))

    def contexts(group: pa.Table) -> pa.Table | None:
        kinds = group.column("kind").to_pylist()
        blobs = [unpack(b) for b in group.column("blob").to_pylist()]
        ctx = [x for x, k in zip(blobs, kinds) if k == "contexts"]
        back = [x for x, k in zip(blobs, kinds) if k == "backoffs"]
        v = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in ctx]) if ctx else np.empty(0, np.uint64)
        name, at = np.unique(v, return_inverse=True)
        stats = [np.bincount(at, np.concatenate([x[i] for x in ctx]), len(name)) for i in range(1, 2 * K + 4)] if ctx else []
        log_a, log_c = context_terms(stats, d2, d1, total) if ctx else (np.empty(0), np.empty(0))
        special = np.isin(name, frequent)
        rows = [(-1, "terms", pack(name[special], (log_a + log_c)[special]))] if special.any() else []
        if back:
            bv = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in back])
            doc, times = np.concatenate([x[1] for x in back]), np.concatenate([x[2] for x in back])
            value = np.zeros(len(bv))
            if len(name):
                place = np.minimum(np.searchsorted(name, bv), len(name) - 1)
                value = np.where(name[place] == bv, (log_a + log_c)[place], 0.0)  # no such context: a(v) = 1
            ids, which = np.unique(doc, return_inverse=True)
            rows += _by_home(ids, homes, "added", [np.bincount(which, value * times, len(ids))])
        return _rows(rows) if rows else None

    joined = stored(by_groups(tables.where("kind in ('contexts', 'backoffs')"), ["part"], contexts, schema), "contexts")
    terms: dict[int, float] = {}
    for (raw,) in joined.where("kind = 'terms'").select("blob").toLocalIterator():  # frequent contexts only
        v, value = unpack(bytes(raw))
        terms |= dict(zip(v.tolist(), value.tolist()))
    term = spark.sparkContext.broadcast(terms)

    def documents(group: pa.Table) -> pa.Table:
        logs2 = np.log10(d2[1:] * np.arange(1, K + 1))
        logs1 = np.log10(np.r_[unknown, d1[1:] * np.arange(1, K + 1) / (total + 1)])
        ids, sums = [], []
        for kind, raw in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist()):
            own, *x = unpack(raw)
            out = np.zeros((len(own), 4))
            if kind == "documents":
                out[:, 0], out[:, 1], out[:, 2] = x[0], x[1], x[2]
                out[:, 3] = np.stack(x[3 : 3 + K], 1) @ logs2 + x[3 + K] - x[2]
                out[:, 3] += np.stack(x[4 + K : 5 + 2 * K], 1) @ logs1 + x[5 + 2 * K] - x[6 + 2 * K] * np.log10(total + 1)
            elif kind == "frequent":
                out[:, 3] = np.array([term.value.get(v, 0.0) for v in x[0].tolist()]) * x[1]
            else:
                out[:, 3] = x[0]
            # added up as they come, so that one document is one row throughout
            ids.append(own), sums.append(out)
            if sum(map(len, ids)) > 4 * TOGETHER:
                ids, sums = _added(ids, sums)
        ids, sums = _added(ids, sums)
        return pa.table({"doc_id": ids[0], "n_tokens": sums[0][:, 0].astype(np.int64), "n_known": sums[0][:, 1].astype(np.int64), "logs": sums[0][:, 2], "value": sums[0][:, 3]})

    parts = tables.where("kind in ('documents', 'frequent')").unionByName(joined.where("kind = 'added'"))
    sums = by_groups(parts, ["part"], documents, "doc_id bigint, n_tokens bigint, n_known bigint, logs double, value double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total + vocabulary + 1))
    if names is not None:
        sums = sums.join(names.withColumn("renamed", F.lit(True)), "doc_id", "left").withColumn("doc_id", F.when(F.col("renamed"), F.col("own")).otherwise(F.col("doc_id")))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), F.col("value").alias("score"))


def _frequent(docs: DataFrame, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that take more than an eighth of a bucket in a sample of about
    2,000 documents (which only decides how pairs are dealt out), and their
    exact training counts. At most 8 n words, end and start marks among them."""
    none = np.empty(0, np.uint64)

    def words(batches):
        for batch in slices(batches, "text"):
            w = tokens(batch.column("text"))[0]
            name, count = np.unique(w, return_counts=True)
            top = np.argsort(-count)[: 16 * n]
            yield pa.RecordBatch.from_arrays([pa.array(name[top].view(np.int64)), pa.array(count[top])], names=["w", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(max(1, rows // 2000))) == 0) if rows > 4000 else docs
    top = sample.select("text").mapInArrow(words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(8 * n).collect()
    if not top:
        return none, np.empty(0, np.int64)
    frequent = np.sort(np.array([r.w for r in top], np.int64).view(np.uint64))

    def exact(batches):
        total = np.zeros(len(frequent), np.int64)
        for batch in slices(batches, "text", SLICE):
            w, _, owner = tokens(batch.column("text"))
            w = w[batch.column("learn").to_numpy(zero_copy_only=False)[owner]]
            at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)
            total += np.bincount(at[frequent[at] == w], minlength=len(frequent))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(frequent))), pa.array(total)], names=["i", "n"])

    found = {r.i: r.n for r in docs.select("text", "learn").mapInArrow(exact, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return frequent, np.array([found.get(i, 0) for i in range(len(frequent))], np.int64)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, id_bucket("doc_id", 7) != 2)
    held = F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
