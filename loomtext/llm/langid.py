"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a lower-cased text in segments of
``SEGMENT`` bytes, in both directions, gives every position a distribution
over the languages, and a document the mean of its positions' distributions.
It is written and trained in numpy by backpropagation through time. Training
uses a bounded sample of labelled rows, whole texts (about ``PER_LANGUAGE``
documents of each language, fewer if these would pass ``LANGUAGE_CHARS``
characters, and none of more than ``ROW_CHARS``); prediction runs over
every byte of every text, inside one narrow pass without a shuffle, and sends
only the trained weights (a few KB) to the executors.

Defined cases: null, empty or letterless text is ``und`` with score 0; very
long texts are cut into segments and read whole; repeated rows give repeated
results; an input without any labelled row gives ``und`` for all; an empty
table gives an empty result; a null id keeps its row; extra columns are left
alone. On ties the first language in order wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_bucket, slices, small_batches, table

HIDDEN = 8
SEGMENT = 64
#: Bounds of the training sample: documents and characters of a language, both
#: on average, and characters of a row.
PER_LANGUAGE, LANGUAGE_CHARS, ROW_CHARS = 400, 1_600_000, 400_000
STEPS, BATCH = 260, 384
#: Segments that are run side by side; sized for the processor's cache.
SIDE_BY_SIDE = 2048


class Network:
    """Weights; column-major in the batch, so that gates are contiguous."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        h, k = HIDDEN, len(languages)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.w = {"out": normal(k, 2 * h), "bias": np.zeros((k, 1), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": normal(3 * h, 256), f"u{d}": normal(3 * h, h), f"c{d}": np.zeros((h, 1), np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, hidden, batch) of bytes ``x`` (time, batch)."""
        h, (steps, batch) = HIDDEN, x.shape
        w, u, c = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"c{d}"]
        states = np.empty((steps, h, batch), np.float32)
        state = np.zeros((h, batch), np.float32)
        g = np.empty((3 * h, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.take(w, x[t], axis=1)
            np.matmul(u, state, out=g)
            gates = a[: 2 * h]
            gates += g[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r, z = gates[:h], gates[h:]
            cand = g[2 * h :]
            cand += c
            n = np.tanh(a[2 * h :] + r * cand)
            if keep is not None:
                keep.append((t, state, r, z, n, cand.copy()))
            state = np.subtract(state, n, out=states[t])
            state *= z
            state += n
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distributions (time, languages, batch) of every position."""
        h = HIDDEN
        y = np.matmul(self.w["out"][:, :h], self._run(x, "f"))
        y += np.matmul(self.w["out"][:, h:], self._run(x, "b"))
        y += self.w["bias"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions but padding, and its gradient."""
        h, (steps, batch) = HIDDEN, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=1)
        y = np.matmul(self.w["out"], states) + self.w["bias"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        real = (x != 0)[:, None, :].astype(np.float32)
        n = max(1.0, float(real.sum()))
        at = (np.arange(steps)[:, None], label[None, :], np.arange(batch)[None, :])
        loss = float(-(np.log(y[at] + 1e-9) * real[:, 0]).sum() / n)
        y[at] -= 1
        y *= real / n
        grad = {"out": np.tensordot(y, states, ((0, 2), (0, 2))), "bias": y.sum((0, 2))[:, None]}
        back = np.matmul(self.w["out"].T, y)
        for d, part in (("f", back[:, :h]), ("b", back[:, h:])):
            u = self.w[f"u{d}"]
            gu, gc = np.zeros_like(u), np.zeros((h, 1), np.float32)
            da = np.empty((steps, 3 * h, batch), np.float32)
            dh = np.zeros((h, batch), np.float32)
            for t, before, r, z, cand_n, cand in reversed(kept[d]):
                dh = dh + part[t]
                dn = dh * (1 - z) * (1 - cand_n * cand_n)
                dz = dh * (before - cand_n) * z * (1 - z)
                dr = dn * cand * r * (1 - r)
                da[t, :h], da[t, h : 2 * h], da[t, 2 * h :] = dr, dz, dn
                dg = np.concatenate([dr, dz, dn * r])
                gu += dg @ before.T
                gc += dg[2 * h :].sum(1, keepdims=True)
                dh = dh * z + u.T @ dg
            flat, code = da.transpose(1, 0, 2).reshape(3 * h, -1), x.ravel()
            grad |= {f"u{d}": gu, f"c{d}": gc, f"x{d}": np.stack([np.bincount(code, row, 256) for row in flat]).astype(np.float32)}
        return loss, grad

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam with a falling rate, languages drawn evenly."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            lang = rng.integers(0, len(groups), BATCH)
            pick = np.array([groups[k][rng.integers(len(groups[k]))] for k in lang])
            loss, grad = self.gradients(segments[pick].T, lang)
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = 0.03 * (1 - (step - 1) / steps) + 0.001
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean distribution (documents, languages) over all positions."""
        x, owner = segmented(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(x), SIDE_BY_SIDE):
            part = np.ascontiguousarray(x[a : a + SIDE_BY_SIDE].T)
            y = self.positions(part)
            y *= (part != 0)[:, None, :]
            np.add.at(total, owner[a : a + SIDE_BY_SIDE], y.sum(0, dtype=np.float64).T)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-300)


def segmented(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes in rows of ``SEGMENT``, zero-padded, and each row's text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    rows = -(-size // SEGMENT)
    owner = np.repeat(np.arange(n), rows)
    first = np.cumsum(rows) - rows
    x = np.zeros(int(rows.sum()) * SEGMENT, np.uint8)
    source = raw[offsets[0] : offsets[-1]]
    target = np.repeat(first * SEGMENT - (offsets[:-1] - offsets[0]), size) + np.arange(len(source))
    x[target] = source
    return x.reshape(-1, SEGMENT), owner


def sample(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The bounded training sample: languages, segments, labels."""
    size = F.length("text")
    usable = labelled.where(F.col("lang").isNotNull() & (size > 0) & (size <= ROW_CHARS))
    counts = {r[0]: max(r[1], PER_LANGUAGE * r[2] / LANGUAGE_CHARS) for r in usable.groupBy("lang").agg(F.count("*"), F.sum(size)).collect()}
    if not counts:
        return [], np.empty((0, SEGMENT), np.uint8), np.empty(0, np.int64)
    # about PER_LANGUAGE of each language, by a hash of the id
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, PER_LANGUAGE / c))]), F.col("lang"))
    rows = usable.where(draw < share).select("doc_id", "lang", "text").orderBy("doc_id").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:
        return [], np.empty((0, SEGMENT), np.uint8), np.empty(0, np.int64)
    x, owner = segmented(rows.column("text").combine_chunks())
    index = {k: i for i, k in enumerate(languages)}
    return languages, x, np.array([index[k] for k in rows.column("lang").to_pylist()])[owner]


def fit(labelled: DataFrame) -> Network | None:
    """Train on ``labelled(doc_id, text, lang)``; None if no row can be used."""
    languages, x, y = sample(labelled)
    if not languages:
        return None
    net = Network(languages)
    net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False))
            if net is None:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                names, lettered = np.array(["und"], object), lettered & False
            else:
                y = net.documents(texts)
                best, score, names = y.argmax(1), y.max(1), np.array(net.languages, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.where(lettered, names[best], "und"), pa.string()), pa.array(np.where(lettered, np.minimum(score, 1.0), 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, lang_pred string, score double")


#: The pipeline rejects a document whose pooled probability is below so many
#: times an even guess among the languages, where there are several.
REJECT_BELOW = 1.2


def threshold(languages: int) -> float:
    """The least pooled probability of a document that stays. One language has
    all probability of any text, so nothing can be told by it."""
    return REJECT_BELOW / languages if languages > 1 else 0.0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(id_bucket("doc_id", 4) != 2))
    return predict(docs, net).select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found: not ``und``, and of a pooled
    probability of ``threshold`` or more. With one learned language every lettered
    text stays. Null, empty and letterless texts go; rows with a null id and repeated rows stay if their
    text does; very long texts are read whole; without any labelled row every
    lettered text stays; an empty table stays empty. Columns stay as they are,
    whatever their names."""
    net = fit(docs.where(id_bucket("doc_id", 4) != 2))
    small_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    def work(batches):
        net = sent.value
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            keep = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False))
            if net is not None:
                keep = keep & (net.documents(texts).max(1) >= threshold(len(net.languages)))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
