"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the hashes of its words, word pairs and skip pairs
(one or two words between), each counted once. FTRL-proximal keeps a rate for
every coordinate, and its L1 term leaves most weights at exactly zero, so the
model that is sent to the executors is a short list of index and weight.

Training reads a bounded sample of the labelled rows (``PER_LABEL`` documents
of each label on average, less if their texts would pass ``TRAIN_CHARS``
characters), passes over it ``EPOCHS`` times, and takes the sampling rates
back out of the intercept. Scoring reads every whole text in one narrow pass.

Defined cases: null and empty texts have no feature and get the intercept's
probability; labels that are null, repeated or of unknown documents are
skipped or joined as they are; without a usable label every score is 0; a
label that is the same everywhere gives its own probability; repeated rows
give repeated results; a null id has no label, but its row is scored; a very long
text is read whole, in one slice of its own; a score of exactly 0.5 is predicted
as 1; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import NOT_WORD, id_bucket, mix, slices, small_batches, table, word_hashes

BITS = 20
#: Bounds of the training sample.
PER_LABEL, TRAIN_CHARS = 4000, 24_000_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text of every occurrence; index 0 is the intercept's."""
    words, starts = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")), space=NOT_WORD)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    index, of = [mix(words)], [owner]
    for gap in (1, 2, 3):  # neighbours, then one and two words skipped
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        left, right = words[:-gap][same], words[gap:][same]
        index.append(mix(left * np.uint64(2 * gap + 1) + (right ^ (right >> np.uint64(29))) + np.uint64(gap)))
        of.append(owner[gap:][same])
    found = np.concatenate(index) >> np.uint64(64 - BITS)
    return np.maximum(found, 1).astype(np.int64), np.concatenate(of)


class Ftrl:
    """FTRL-proximal state: z and n of each coordinate."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.where(np.asarray(at) == 0, 0.0, L1)  # the intercept is not shrunk
        return np.where(np.abs(z) <= free, 0.0, -(z - np.sign(z) * free) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> float:
        w = self.weights(at)
        p = sigmoid(w.sum())
        g = p - label
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g
        return p

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((np.abs(self.z) > L1) | (np.arange(1 << BITS) == 0))
        w = self.weights(at)
        return at[(w != 0) | (at == 0)], w[(w != 0) | (at == 0)]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Index and weight of the non-zero coordinates, from ``docs(doc_id, text)``
    and ``labels(doc_id, toxic)``; None without a usable row. Ids and lengths
    alone are joined by shuffle; the sampled ids, of bounded number, are sent
    to the texts."""
    labels = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = docs.select("doc_id", F.length("text").alias("size")).join(labels, "doc_id")
    size = {r[0]: (r[1], r[2] or 0) for r in usable.groupBy("toxic").agg(F.count("*"), F.sum("size")).collect()}
    if not size:
        return None
    share = {k: min(1.0, PER_LABEL / n, TRAIN_CHARS / 2 / max(1, chars)) for k, (n, chars) in size.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    wanted = F.when(F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    drawn = usable.where(draw < wanted).select("doc_id", "toxic").distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    if not rows.num_rows:
        return None
    texts, labels = rows.column("text"), np.array(rows.column("toxic").to_pylist(), float)
    each: list[np.ndarray] = []
    for a in range(0, len(labels), 256):
        part = texts.slice(a, 256).combine_chunks()
        index, of = features(part)
        pairs = np.unique(of << BITS | index)
        cut = np.searchsorted(pairs >> BITS, np.arange(len(part) + 1))
        at = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        each += [np.concatenate([[0], at[i:j]]) for i, j in zip(cut, cut[1:])]
    model, rng = Ftrl(), np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(each)):
            model.learn(each[k], labels[k])
    at, w = model.compact()
    if set(share) == {0, 1}:
        w[at == 0] -= np.log(share[1] / share[0])
    return at, w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``doc_id, score`` of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        if sent.value is not None:
            dense[sent.value[0]] = sent.value[1]
        used = dense != 0
        for batch in slices(batches, "text"):
            index, of = features(batch.column("text"))
            hit = used[index]
            pairs = np.unique(of[hit] << BITS | index[hit])
            total = dense[0] + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], batch.num_rows)
            value = sigmoid(total) if sent.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(value)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null")
    model = fit(docs.where(id_bucket("doc_id", 5) != 0), labels.where(id_bucket("doc_id", 5) != 0))
    return score(docs, model).select(
        "doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
