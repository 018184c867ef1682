"""BPE encoding and decoding by a distinct-word table.

Documents are put into groups of about ``GROUP_BYTES`` of text and stored with
their group's number, bucketed by it, so that no text is shuffled afterwards.
The texts are split into pre-tokens ("words"); a group gives each of its
distinct words once. These rows are dealt out by word, where every distinct
word of the corpus is met as one run and encoded once, and go back to their
groups with the word's ids. A group and its words meet in one task, which puts
the ids back by position. Decoding takes each id of the document to its piece
through the id-to-piece table of the vocabulary (50,257 rows: bounded,
broadcast).

Defined cases: null and empty text give no ids; a special token's string
inside a text becomes its id, as in the library; very long texts are encoded
whole (one makes a large group); ties don't arise; repeated rows give repeated
results; a null id keeps its row; an empty table gives an empty result; extra
columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bucketed
from ._shared import slices, small_batches, table, trim

#: Text of a group of documents, about.
GROUP_BYTES = 48 << 20
#: The tokenizer's file in the package of vocabularies.
VOCABULARY = "byte_bpe_50k.json"

# The pre-token pattern of byte-level BPE, with Unicode's
# White_Space spelled out (Python counts \x1c-\x1f as space, the library doesn't).
_S = r"\t-\r \x85\xa0  -     　"

def _pattern(letters: str, numbers: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_S}{letters}{numbers}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


#: The last character up to which the library knows the same letters and numbers.
LAST = 0x52F


def _ranges(kind: str) -> str:
    """The characters of a class up to LAST, for ``re``, which has no such
    classes but takes half the time of ``regex``."""
    found = [k for k in range(LAST + 1) if regex.match(rf"\p{{{kind}}}", chr(k))]
    first, last = [k for k in found if k - 1 not in found], [k for k in found if k + 1 not in found]
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(first, last))


PATTERN = _pattern(_ranges("L"), _ranges("N"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Splitter, word encoder and pieces of a vocabulary. ``source``: the
    tokenizer's JSON."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = re.compile(PATTERN)
        self.later = re.compile(rf"[^\x00-\u{LAST:04x}]")
        shown = _byte_codes()
        code = {c: b for b, c in shown.items()}
        self.shown = str.maketrans({chr(b): c for b, c in shown.items()})
        self.model = self.tokenizer.model
        self.piece = {i: bytes([code[c] for c in p]) for p, i in spec["model"]["vocab"].items()}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.pieces_of = [self.piece.get(i, b"") for i in range(max(self.piece) + 1)]
        self.names = [str(i) for i in range(len(self.pieces_of))]

    def pieces(self, text: str) -> list[str]:
        # The two regex engines know different versions of Unicode. Up to
        # U+052F they agree; beyond, the library splits.
        if text.isascii() or not self.later.search(text):
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of ``text``, special tokens among them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.pieces(part)
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [x.id for x in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.shown))]


def _byte_codes() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: visible Latin-1
    characters stand for themselves, the others follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


def _source(spark, path: str | None):
    small_batches(spark)
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, text, part`` stored, bucketed by the group's number.

    A partition is cut by its running bytes of text in the whole number of
    groups that comes nearest to ``GROUP_BYTES`` each, or to an even share of
    the cores if that is less. So a group holds at most one and a half times
    that and one document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sizes = _partition_bytes(docs)
    each = max(1, min(GROUP_BYTES, math.ceil(sum(sizes.values()) / spark.sparkContext.defaultParallelism)))
    groups = max(1, math.ceil(sum(sizes.values()) / each))
    whole = docs.rdd.getNumPartitions()
    if whole > groups:
        docs, whole = docs.coalesce(groups), groups
        sizes = _partition_bytes(docs)
    cuts = {p: math.ceil(n / max(1, round(n / each))) for p, n in sizes.items()}
    docs = docs.withColumn("part", F.spark_partition_id())
    if any(sizes[p] > cuts[p] for p in sizes):
        small_batches(spark)
        docs = docs.mapInArrow(_numbered(spark.sparkContext.broadcast(cuts), whole), docs.schema)
    return bucketed(docs, "grouped", 2 * max(groups, whole), "part")


def _partition_bytes(docs: DataFrame) -> dict[int, int]:
    """Bytes of text in each partition that has any: a number a partition."""
    rows = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    return {r.p: r.n for r in rows if r.n}


def _numbered(cuts, partitions: int):
    """Work that raises ``part`` by ``partitions`` after every ``cuts[part]``
    bytes of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("part")[0].as_py()
            ends = before + np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
            starts = np.r_[before, ends[:-1]]
            before = int(ends[-1])
            part = first + partitions * (starts // cuts.value.get(first, GROUP_BYTES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(part.astype(np.int32))], names=["doc_id", "text", "part"])

    return work


def _words(grouped: DataFrame, source) -> DataFrame:
    """``part, word``: the distinct words of each group (of its part in a task)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = Codec(source.value), {}

        def given(part: int) -> pa.RecordBatch:
            words = sorted(seen.pop(part))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), part, np.int32)), pa.array(words, pa.string())], names=["part", "word"])

        for batch in slices(batches, "text"):
            parts = batch.column("part").to_numpy()
            for part, text in zip(parts.tolist(), batch.column("text").to_pylist()):
                if text:
                    seen.setdefault(part, set()).update(codec.split(text))
            for part in [p for p in seen if p != parts[-1]]:
                yield from _cut(given(part))
        for part in list(seen):
            yield from _cut(given(part))

    return grouped.mapInArrow(work, "part int, word string")


def _cut(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def word_table(words: DataFrame, source) -> DataFrame:
    """``part, word, ids`` of ``words(part, word)``: equal words follow each
    other, and each distinct one is encoded once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last, ids = Codec(source.value), None, b""
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, np.array(codec.ids(word), np.uint32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("word"), pa.array(out, pa.binary())], names=["part", "word", "ids"])

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(work, "part int, word string, ids binary")


def _joined(docs: DataFrame, path: str | None, schema: str, columns: list[pa.DataType], row) -> DataFrame:
    """Of every document what ``row`` makes of its ids and the pieces."""
    spark = docs.sparkSession
    source = _source(spark, path)
    grouped = _grouped(docs)
    words = word_table(_words(grouped, source), source)
    names = [x.split()[0] for x in schema.split(", ")]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        codec, ids, out = Codec(source.value), {}, []
        number = list(range(len(codec.pieces_of)))  # one object for each id
        for batch in right.to_batches(max_chunksize=10_000):
            for w, x in zip(batch.column("word").to_pylist(), batch.column("ids").to_pylist()):
                ids[w] = tuple([number[i] for i in np.frombuffer(x, np.uint32).tolist()])
        for batch in slices(iter(left.to_batches()), "text"):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = list(chain.from_iterable(map(ids.__getitem__, codec.split(text or ""))))
                out.append((i, *row(codec, found)))
        del ids
        trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), columns)] if out else [pa.array([], t) for t in columns], names=names)

    return grouped.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(work, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids array<bigint>`` of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _joined(docs, path, "doc_id bigint, ids array<bigint>", [pa.int64(), pa.list_(pa.int64())], lambda codec, ids: (ids,))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give ''. Ids
    without a piece give nothing; bytes that aren't UTF-8 give U+FFFD."""
    source = _source(encoded.sparkSession, path)
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches):
        piece = Codec(source.value).piece
        for b in batches:
            texts = [b"".join([piece.get(i, b"") for i in ids or ()]).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the round trip."""

    def row(codec, ids):
        back = b"".join(map(codec.pieces_of.__getitem__, ids)).decode("utf-8", "replace")
        return len(ids), hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _joined(docs, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()], row)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
