"""Katz back-off models of any order as tables, evaluated by recursive joins.

``grams``: ``n, context, word, count, log_p`` of every n-gram seen in training;
``contexts``: ``n, context, count, log_backoff`` of every context of an n-gram
of order 2 and up; ``terms``: ``word, term`` names the words. All are Parquet
tables, the first two partitioned in ``n``, that can be queried and joined;
words and contexts are 64-bit hashes (of a context's words together).

The formulas are those of ``katz``, carried to any order:

    P(w | u)  = d c(u,w) / (c(u) + 1)    if (u, w) was seen in training
              = a(u) P(w | u')           if not; u' is u without its first word
    a(u)      = (1 - sum of P(w | u) over seen w) / (1 - sum of P(w | u') over seen w)

so that every context's distribution sums to one. A text begins with order - 1
start marks, so that each of its tokens ends one n-gram of every order: counts
of order n - 1 are sums of those of order n, and the text is read once.

``evaluate`` looks the distinct n-grams of all texts up at the highest order;
those not found go down an order, each distinct shorter n-gram once, and come
back with their context's weight. Every step is a join or a grouping of distinct
n-grams, aggregated map-side; a hot word's rows are joined whole, split by
Spark's handling of skewed joins. Tokens are joined with the results last.

Defined cases: null and empty texts are an end mark; without training text every
word is unknown, with P 1; rows with null or repeated ids are scored alone; very
long texts are scored whole; ties don't arise; an empty table gives an empty
result; extra columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_bucket, stored, table
from .katz import END, START, K, _keyed, discounts

#: The tables of a saved model.
SCHEMAS = {
    "grams": "n int, context long, word long, count long, log_p double",
    "contexts": "n int, context long, count long, log_backoff double",
    "terms": "word long, term string",
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _keys(order: int) -> list[str]:
    """The columns that name an n-gram: its word and its contexts, ``x1`` the
    word before, ``x2`` the two words before, and so on."""
    return ["word", *[f"x{k}" for k in range(1, order)]]


def ngrams(docs: DataFrame, order: int, *keep: str) -> DataFrame:
    """``keep, word, x1, .., x(order-1)``: a row for every token."""
    start, end = (F.lit(int(x)).cast("bigint") for x in (START, END))
    hashes = F.concat(F.array_repeat(start, order - 1), F.transform(_terms(F.col("text")), lambda x: F.xxhash64(x)), F.array(end))

    def gram(i: Column) -> Column:
        at = lambda back: F.get(F.col("hashes"), i + (order - 1 - back))
        before = [at(1).alias("x1")] if order > 1 else []
        before += [F.xxhash64(*[at(b) for b in range(k, 0, -1)]).alias(f"x{k}") for k in range(2, order)]
        return F.struct(at(0).alias("word"), *before)

    rows = docs.select(*keep, hashes.alias("hashes"))
    return rows.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.size("hashes") - order), gram)))


@dataclass
class Model:
    order: int
    grams: DataFrame
    contexts: DataFrame
    terms: DataFrame
    total: int  # training tokens
    vocabulary: int  # distinct ones
    unknown: float  # P of all unknown words

    def save(self, path: str) -> None:
        self.grams.write.partitionBy("n").parquet(f"{path}/grams")
        self.contexts.write.partitionBy("n").parquet(f"{path}/contexts")
        self.terms.write.parquet(f"{path}/terms")
        row = [(self.order, self.total, self.vocabulary, self.unknown)]
        self.grams.sparkSession.createDataFrame(row, "order int, total long, vocabulary long, unknown double").coalesce(1).write.parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        order, total, vocabulary, unknown = spark.read.parquet(f"{path}/model").first()
        return Model(order, *[spark.read.schema(SCHEMAS[x]).parquet(f"{path}/{x}") for x in SCHEMAS], total, vocabulary, unknown)


def _context(n: int) -> Column:
    return F.col(f"x{n - 1}") if n > 1 else F.lit(0).cast("bigint")


def train(docs: DataFrame, order: int) -> Model:
    """The model of order ``order`` of ``docs(text)``."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    counts = {order: stored(ngrams(docs, order).groupBy(*_keys(order)).agg(F.count("*").alias("count")), f"counts{order}")}
    for n in range(order - 1, 0, -1):
        counts[n] = stored(counts[n + 1].groupBy(*_keys(n)).agg(F.sum("count").alias("count")), f"counts{n}")
    total, vocabulary = counts[1].agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    lower, grams, contexts = None, [], []
    for n in range(1, order + 1):
        few = {r["count"]: r.n for r in counts[n].where(F.col("count") <= K + 1).groupBy("count").agg(F.count("*").alias("n")).collect()}
        d = discounts(np.array([0, *[few.get(r, 0) for r in range(1, K + 2)]]))
        kept = F.when(F.col("count") <= K, F.element_at(F.array(*[F.lit(float(x)) for x in d[1:]]), F.least("count", F.lit(K)).cast("int"))).otherwise(1.0) * F.col("count")
        if n == 1:
            seen = sum((d[r] - 1) * r * few.get(r, 0) for r in range(1, K + 1)) + total
            unknown = 1 - seen / (total + 1)
            lower = stored(counts[1].withColumn("p", kept / (total + 1)), "grams1")
        else:
            of = counts[n].withColumn("kept", kept).join(lower.select(*_keys(n - 1), F.col("p").alias("below")), _keys(n - 1))
            sums = of.groupBy(f"x{n - 1}").agg(F.sum("count").alias("c"), F.sum("kept").alias("k"), F.sum("below").alias("b"))
            weight = (1 - F.col("k") / (F.col("c") + 1)) / F.greatest(1 - F.col("b"), F.lit(1e-300))
            sums = stored(sums.select(f"x{n - 1}", "c", F.log10(weight).alias("log_backoff")), f"contexts{n}")
            contexts.append(sums.select(F.lit(n).alias("n"), F.col(f"x{n - 1}").alias("context"), F.col("c").alias("count"), "log_backoff"))
            lower = stored(counts[n].withColumn("kept", kept).join(sums, f"x{n - 1}").select(*_keys(n), "count", (F.col("kept") / (F.col("c") + 1)).alias("p")), f"grams{n}")
        grams.append(lower.select(F.lit(n).alias("n"), _context(n).alias("context"), "word", "count", F.log10("p").alias("log_p")))
    none = spark.createDataFrame([], SCHEMAS["contexts"])
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term")).distinct().select(F.xxhash64("term").alias("word"), "term")
    return Model(order, _united(grams), _united(contexts) if contexts else none, words, total, vocabulary, float(unknown))


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def look_up(model: Model, asked: DataFrame, n: int) -> DataFrame:
    """``word, x1, .., x(n-1), log_p`` of the distinct n-grams ``asked``."""
    grams = model.grams.where(F.col("n") == n)
    if n == 1:
        known = grams.select("word", "log_p")
        return asked.join(known, "word", "left").select("word", F.coalesce("log_p", F.lit(math.log10(model.unknown))).alias("log_p"))
    keys, shorter = _keys(n), _keys(n - 1)
    known = grams.select(F.col("context").alias(f"x{n - 1}"), "word", "log_p")
    met = stored(asked.join(known, ["word", f"x{n - 1}"], "left").select(*keys, "log_p"), f"met{n}")
    missed = met.where("log_p is null").drop("log_p")
    below = look_up(model, missed.select(*shorter).distinct(), n - 1)
    weights = model.contexts.where(F.col("n") == n).select(F.col("context").alias(f"x{n - 1}"), "log_backoff")
    down = missed.join(below, shorter).join(weights, f"x{n - 1}", "left")
    down = down.select(*keys, (F.col("log_p") + F.coalesce("log_backoff", F.lit(0.0))).alias("log_p"))  # no such context: a(u) = 1
    return met.where("log_p is not null").unionByName(down)


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every
    row of ``docs(doc_id, text)``, as ``katz.score`` gives them."""
    keys = _keys(model.order)
    docs, names = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = ngrams(docs, model.order, "doc_id")
    found = look_up(model, rows.select(*keys).distinct(), model.order)
    seen = model.grams.where("n = 1").select("word", F.col("count").alias("c"))
    found = stored(found.join(seen, "word", "left"), "found")
    sums = rows.join(found, keys).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.count("c").alias("n_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs"), F.sum("log_p").alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(model.total + model.vocabulary + 1))
    if names is not None:
        sums = sums.join(names.withColumn("renamed", F.lit(True)), "doc_id", "left").withColumn("doc_id", F.when(F.col("renamed"), F.col("own")).otherwise(F.col("doc_id")))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def trigram_scores(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    """What ``katz.query`` gives, by tables of the given order."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(id_bucket("doc_id", 7) != 2), order)
    out = evaluate(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
