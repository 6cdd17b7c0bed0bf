"""Command line: ``python -m pangrove index|alleles|walks|bundle GRAPH OUT``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from pangrove.operators import encode, index, place, walks
from pangrove.plans import build, files
from pangrove.sources import gfa


def component_limit(text: str) -> int | None:
    """A number of nodes, or ``none`` for no limit."""
    return None if text == "none" else int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pangrove")
    of = out.add_subparsers(dest="what", required=True)
    for what in ("index", "alleles", "walks", "bundle"):
        p = of.add_parser(what)
        p.add_argument("graph")
        p.add_argument("out")
        p.add_argument("--reference")
        p.add_argument("--max-component", type=component_limit, default=index.MAX_COMPONENT)
        if what == "index":
            p.add_argument("--layout", choices=("contig", "anchored"), default="anchored")
        if what == "walks":
            for name, value in (("tile", walks.TILE), ("stay", walks.STAY), ("abridge", encode.STEPS), ("abridge-bytes", encode.BYTES)):
                p.add_argument(f"--{name}", type=int, default=value)
        if what == "bundle":
            p.add_argument("--below", type=int)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pangrove").getOrCreate()
    if args.what == "walks":
        if not args.reference:
            raise place.Refusal("walks need the sample that is their reference")
        return files.write_walks(gfa.read_walks(spark, args.graph), args.reference, args.out, args.tile, args.stay, args.abridge, args.abridge_bytes)
    if args.what == "alleles":
        rows = files.alleles_of(spark, args.graph)
        rows.write.mode("overwrite").parquet(args.out)
        return {r["class"]: r.n for r in files.class_counts(spark.read.parquet(args.out)).collect()}
    graph = gfa.read_gfa(spark, args.graph)
    if args.what == "bundle":
        return build.build(graph, args.out, args.reference, args.below, args.max_component)
    graph, placed = place.place(graph, args.reference)
    return files.write_graph(graph, placed, args.out, args.layout, args.max_component)


if __name__ == "__main__":
    print(json.dumps(main(), indent=2))
