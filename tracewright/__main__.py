"""`python -m tracewright`: pack PAF text, unpack, view and measure containers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import seek_times
from .operators.selection import parse_strategy
from .plans import convert
from .sources import container


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tracewright")
    sub = p.add_subparsers(dest="command", required=True)
    pack = sub.add_parser("pack", help="PAF text (- for standard input) to a container")
    pack.add_argument("source")
    pack.add_argument("path")
    pack.add_argument("--first", default="automatic")
    pack.add_argument("--second", default="automatic")
    pack.add_argument("--variant", default="standard", choices=container.VARIANTS)
    pack.add_argument("--metric", default="edit-distance", choices=container.METRICS)
    pack.add_argument("--max-complexity", type=int, default=32)
    pack.add_argument("--all-records", action="store_true")
    pack.add_argument("--contigs", help="name, start and end of contigs, by tabs (fastga)")
    unpack = sub.add_parser("unpack", help="a container to a folder of PAF text")
    unpack.add_argument("path")
    unpack.add_argument("folder")
    view = sub.add_parser("view", help="header, names and records")
    view.add_argument("path")
    view.add_argument("--strategies", action="store_true")
    sub.add_parser("sizes", help="bytes by section").add_argument("path")
    seek = sub.add_parser("seek", help="times to open and to read single traces")
    seek.add_argument("path")
    seek.add_argument("--positions", type=int, default=100)
    seek.add_argument("--iterations", type=int, default=100)
    a = p.parse_args(argv)
    if a.command == "view" and a.strategies:
        print(convert.strategies(a.path))
        return
    spark = SparkSession.builder.appName("tracewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "pack":
        h = container.Header(parse_strategy(a.first), parse_strategy(a.second), a.variant, a.metric, a.max_complexity, all_records=a.all_records)
        contigs = a.contigs and spark.read.csv(a.contigs, sep="\t", schema="name string, start bigint, end bigint")
        for k, n in convert.paf_to_container(spark, a.source, a.path, h, contigs or None).items():
            print(f"{k}\t{n}")
    elif a.command == "unpack":
        convert.container_to_paf(spark, a.path, a.folder)
    elif a.command == "view":
        for text in convert.view(spark, a.path):
            print(text)
    elif a.command == "seek":
        for k, v in seek_times.seek_report(spark, a.path, a.positions, a.iterations).items():
            print(f"{k}\t{v:.3f}")
    else:
        for r in container.size_report(spark, a.path).collect():
            print(f"{r.section}\t{r.part}\t{r.bytes}\t{r.share:.4f}\t{r.average if r.average is None else round(r.average, 2)}")


if __name__ == "__main__":
    main()
