"""Command line: screen tables, texts or images and write a report.

python -m tallyglass tables FILE... [--cross-file] [--order COL,...] [-o PATH] [-f json|markdown]
python -m tallyglass sequences FILE... [--min-pairs N] [--p-threshold P]
python -m tallyglass texts PATH [-o PATH]
python -m tallyglass emails DATABASE
python -m tallyglass simulate [--n-sim N] [--n-per-group N] [--n-groups N] [--n-variables N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.relational import column_pairs
from .operators import columns, crossdoc, pairs, simulation, text
from .plans import findings as fi
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyglass", description="Screens research data and papers for signs of fabrication.")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tables")
    t.add_argument("files", nargs="+")
    t.add_argument("-x", "--cross-file", action="store_true")
    t.add_argument("--order", default="")
    s = sub.add_parser("sequences")
    s.add_argument("files", nargs="+")
    s.add_argument("--min-pairs", type=int, default=3)
    s.add_argument("--p-threshold", type=float, default=0.01)
    s.add_argument("--all", action="store_true")
    x = sub.add_parser("texts")
    x.add_argument("path")
    e = sub.add_parser("emails")
    e.add_argument("database")
    m = sub.add_parser("simulate")
    for name, default in (("--n-sim", 1000), ("--n-per-group", 60), ("--n-groups", 4), ("--n-variables", 8)):
        m.add_argument(name, type=int, default=default)
    for one in (t, s, x, e, m):
        one.add_argument("-o", "--output")
        one.add_argument("-f", "--format", choices=("json", "markdown"), default="json")
    return p


def run(spark: SparkSession, args: argparse.Namespace):
    """The DataFrame a command asks for."""
    if args.command == "tables":
        cells = readers.tables_cells(spark, args.files, order=args.order.split(",") if args.order else None)
        out = fi.detect_cells(cells)
        if args.cross_file:
            long = cells.select("source", "col_pos", "col", "idx", "value")
            out = out.unionByName(fi.to_findings(pairs.cross_source_difference(column_pairs(long, across_sources=True)), "CROSS_FILE_FIXED_DIFFERENCE"))
        return out
    if args.command == "sequences":
        cells = readers.tables_cells(spark, args.files, min_values=4)
        found = columns.value_sequence(cells, args.min_pairs, args.p_threshold)
        return (found if args.all else found.where("flagged")).orderBy("p", "source", "col")
    if args.command == "texts":
        docs = readers.text_documents(spark, args.path)
        return text.conclusions(docs).join(docs.select("doc_id", "path"), "doc_id")
    if args.command == "emails":
        return crossdoc.roll_up(readers.email_database(spark, args.database))
    wide = simulation.trial_rows(spark, args.n_sim, args.n_per_group, args.n_groups, args.n_variables)
    names = [c for c in wide.columns if c not in ("source", "idx")]
    return simulation.false_positive_rates(fi.detect_tables(wide, names), args.n_sim)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("tallyglass").getOrCreate()
    out = run(spark, args)
    if args.output and args.command == "tables":
        (sinks.write_markdown if args.format == "markdown" else sinks.write_json)(out, args.output)
    elif args.output:
        out.write.mode("overwrite").json(args.output)
    else:
        out.orderBy(*[F.col(c) for c in out.columns if c in ("source", "p")]).show(200, truncate=120)


if __name__ == "__main__":
    main()
