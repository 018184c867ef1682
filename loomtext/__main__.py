"""Build an index from the command line.

``python -m loomtext TABLE KEY TEXT OUT`` of a Parquet table's columns, ``--fasta
PATH OUT`` of FASTA files, ``--l1-prefix PREFIX OUT`` of dictionaries and second
parse that were built elsewhere. Options may stand in a file, ``--configure FILE``,
as ``name = value`` lines without the dashes; those of the command line come first.
"""

from __future__ import annotations

import argparse
import configparser
import logging
import os

from . import __version__


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomtext", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("place", nargs="*", help="TABLE KEY TEXT OUT, or OUT alone with --fasta or --l1-prefix")
    p.add_argument("--fasta", help="FASTA files to read")
    p.add_argument("--l1-prefix", help="prefix of the files .dict, .parse.dict and .parse.parse")
    p.add_argument("--integer-shift", type=int, default=10, help="what ids in .parse.dict are raised by")
    p.add_argument("--w1", type=int, default=4)
    p.add_argument("--p1", type=int, default=11)
    p.add_argument("--w2", type=int, default=2)
    p.add_argument("--p2", type=int, default=5)
    p.add_argument("--chunks", type=int, default=0, help="also write a division of the result in so many ranges, 1 to 1000")
    p.add_argument("--bwt-only", action="store_true", help="no suffix-array samples")
    p.add_argument("--flat", action="store_true", help="also write the flat layouts, in parts")
    p.add_argument("--tmp-dir", help="the folder of intermediate tables, which all executors share")
    p.add_argument("--configure", help="a file of options")
    p.add_argument("--version", action="version", version=__version__)
    return p


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    p = options()
    first, _ = p.parse_known_args(arguments)
    if first.configure:
        c = configparser.ConfigParser()
        with open(first.configure) as f:
            c.read_string("[options]\n" + f.read())
        given = {k.replace("-", "_"): v for k, v in c["options"].items()}
        known = {a.dest: a for a in p._actions}
        for k, v in given.items():
            if k not in known or k in ("configure", "place", "version", "help"):
                p.error(f"no option {k} in a file")
            given[k] = c["options"].getboolean(k.replace("_", "-"), fallback=None) if known[k].const is True else v
        p.set_defaults(**given)
    a = p.parse_args(arguments)
    if len(a.place) != (1 if a.fasta or a.l1_prefix else 4):
        p.error("give TABLE KEY TEXT OUT, or OUT with --fasta or --l1-prefix")
    if a.fasta and a.l1_prefix:
        p.error("give one of --fasta and --l1-prefix")
    if a.tmp_dir and "://" not in a.tmp_dir and not os.path.isdir(a.tmp_dir):
        p.error(f"no folder {a.tmp_dir}")
    return a


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .index import TextIndex
    from .operators.samples import skipped

    a = parsed(arguments)
    log = logging.getLogger("loomtext")
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    if a.tmp_dir:
        spark.conf.set("spark.checkpoint.dir", a.tmp_dir if "://" in a.tmp_dir else f"file://{os.path.abspath(a.tmp_dir)}")
    out = a.place[-1]
    if a.l1_prefix:
        x = TextIndex.of_files(spark, a.l1_prefix, a.w1, a.w2, a.integer_shift)
    elif a.fasta:
        x = TextIndex.of_fasta(spark, a.fasta, a.w1, a.p1, a.w2, a.p2)
    else:
        table, key, text, _ = a.place
        x = TextIndex.of_table(spark.read.parquet(table).select(key, text), key, text, a.w1, a.p1, a.w2, a.p2)
    log.info("%d symbols, %d phrases and %d of the second level", x.n, x.dict1.count(), x.dict2.count())
    x.save(out, a.bwt_only)
    if a.flat:
        x.save_flat(f"{out}/flat", a.bwt_only)
    if a.chunks:
        x.chunk_plan(a.chunks).write.mode("overwrite").parquet(f"{out}/chunks")
    for r in x.all_pieces.groupBy("tier").sum("len").collect():
        log.info("%s: %d symbols", *r)
    if not a.bwt_only:
        for r in skipped(x.groups, x.rlbwt, x.suffix1, x.m_table, x.expansion).collect():
            log.info("samples, %s: %d rows, %d symbols", *r)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
