"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset
    (single-machine sessions and tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = getattr(spark, "_loomtext_dir", None)
        if place is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            place = "file://" + tempfile.mkdtemp(prefix="loomtext-")
            spark._loomtext_dir = place
    return place


def measured_broadcasts(spark: SparkSession) -> None:
    """Let adaptive execution alone choose broadcast joins, by the measured size
    of what was shuffled and the same threshold. Beforehand Spark judges by the
    size of files, which for compressed stored tables is a small part of their
    rows', and the driver would have to hold these."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(static)
    if limit != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, limit)
        spark.conf.set(static, "-1")


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """``measured_broadcasts`` for what is written inside."""
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(n, None) for n in names]
    measured_broadcasts(spark)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _remove(spark_ref, path: str) -> None:
    spark = spark_ref()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    the files outlive executors. They are removed when the process ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, weakref.ref(spark), path)
    return spark.read.schema(df.schema).parquet(path)


def done_with(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(weakref.ref(df.sparkSession), path)


def bucketed(df: DataFrame, tag: str, buckets: int, column: str) -> DataFrame:
    """``stored``, but bucketed by ``column``, so that joins and groups by it
    need no shuffle of this side. The catalogue knows the table only while it is
    written and found again; the files are in the shared folder."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    atexit.register(_remove, weakref.ref(spark), path)
    out = spark.table(name)  # resolved here: it needs the catalogue no more
    spark.sql(f"DROP TABLE {name}")
    return out
