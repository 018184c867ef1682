"""The corpus pipeline, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, STAGES, run
from loomtext.llm import bpe
from loomtext.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = rows, []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept.append(docs.count())
        if name != STAGES[-1][0]:
            assert docs.columns == rows.columns
    assert len(STAGES) == 5 and kept == sorted(kept, reverse=True) and kept[-1] > 0.7 * rows.count()
    assert sorted(docs.collect()) == sorted(run(spark, SF).collect())
    assert ORACLE_SQL is None


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, a shared passage and a leaked item among clean
    documents of one language each."""
    rng = random.Random(2)
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if 300 < r.n_chars < 3000][:40]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    say = lambda n: " ".join("".join(rng.choice(["the", "ing", "er", "an", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(r.doc_id, r.text) for r in base]
    a, b, passage = say(200), say(200), say(70)
    rows += [(10_001, a), (10_002, a), (10_003, a + " end"), (10_004, b + " " + passage), (10_005, passage + " " + say(150)), (10_006, say(60) + " " + item + " " + say(60)), (10_007, "1234 5678 --")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 10_007 not in seen["language_id"] and len(seen["language_id"]) == len(rows) - 1
    near = seen["ngram_jaccard_join"]
    assert 10_001 in near and 10_002 not in near and 10_003 not in near and 10_006 in near
    cut = seen["substring_dedup"]
    assert cut[10_004] == b + " " + passage and passage not in cut[10_005] and cut[10_001] == a
    assert 10_006 not in seen["benchmark_decontamination"] and {10_001, 10_004, 10_005} <= set(seen["benchmark_decontamination"])
    assert bpe.digests(docs).count() == len(seen["benchmark_decontamination"])


@pytest.mark.parametrize("languages", [1, 2, 4])
def test_language_stage_keeps_lettered_text(spark, languages):
    """Clean documents stay however many languages the labels have."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(["en", "de", "fr", "es"][:languages]))
    junk = spark.createDataFrame([(-1, "12 34 --"), (-2, ""), (-3, None)], "doc_id long, text string")
    both = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r.doc_id for r in STAGES[0][1](spark, both, SF).collect()}
    assert kept == {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()}
