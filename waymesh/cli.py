"""Command line: GPS files to a movement graph.

    python -m waymesh 'gps/*' -o out --nodes --edges --graph --json -t 4h -M

Input is named by paths (files, folders or patterns in any store that Spark
reads), not read from standard input, which only the driver sees.  Each output is
a folder of part files below ``--output``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, duration_ms
from .operators import clean
from .plans import graph
from .sources import readers, sinks

KEYS, ORDER = ["stream_id", "day", "run"], ["seq"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymesh", description="Builds a movement graph from GPX, PLT, AIS or CSV files.")
    p.add_argument("paths", nargs="+", help="files, folders or patterns")
    p.add_argument("-o", "--output", help="folder for output; needed if anything is to be written")
    p.add_argument("-c", "--config", help="JSON file of settings; missing keys keep their defaults")
    p.add_argument("-t", "--temporal-slack", help="at most 24 hours, with h for hours or m for minutes: 4h, 15m; 24h clusters by space alone")
    p.add_argument("--clustering-threshold", type=float, help="greatest distance of two points of a cluster, in metres")
    p.add_argument("-n", "--nodes", action="store_true", help="write nodes as CSV")
    p.add_argument("-e", "--edges", action="store_true", help="write edges as CSV")
    p.add_argument("-d", "--graph", action="store_true", help="write the graph as DOT")
    p.add_argument("-j", "--json", action="store_true", help="write the graph as JSON lines")
    p.add_argument("-p", "--parquet", action="store_true", help="write nodes and edges as Parquet")
    shape = p.add_mutually_exclusive_group()
    shape.add_argument("-C", "--use-centroids", action="store_true", help="a mean trajectory stands for a cluster of edges")
    shape.add_argument("-M", "--use-medoids", action="store_true", help="one of its edges stands for a cluster (default)")
    p.add_argument("--format", choices=readers.LINE_FORMATS, help="format of all files: they are then read line by line, and large ones in parts")
    p.add_argument("--ignore-ids", action="store_true", help="vessels and users of a file are one stream")
    p.add_argument("--filter-spikes", action="store_true", help="drop points that stand out of their neighbours' hull")
    p.add_argument("--stops", action="store_true", help="nodes from stops within the streams, not from their ends")
    return p


def formats_of(args: argparse.Namespace) -> tuple[str, ...]:
    wanted = {"parquet": args.parquet, "nodes_csv": args.nodes, "edges_csv": args.edges, "json": args.json, "dot": args.graph}
    return tuple(name for name, on in wanted.items() if on)


def config_of(spark: SparkSession, args: argparse.Namespace) -> Config:
    config = Config()
    if args.config:
        config = Config.from_json(spark.read.text(args.config, wholetext=True).first().value)
    changes = {"use_centroids": args.use_centroids}
    if args.temporal_slack:
        changes["temporal_slack_ms"] = duration_ms(args.temporal_slack)
    if args.clustering_threshold is not None:
        changes["clustering_threshold"] = args.clustering_threshold
    return replace(config, **changes)


def points_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Points with ``run`` (days in a row) and an ``id``."""
    if args.format:
        points = readers.read_lines(spark, args.paths, args.format, ignore_ids=args.ignore_ids)
    else:
        points = readers.read_points(readers.text_files(spark, args.paths), ignore_ids=args.ignore_ids)
    return clean.day_runs(points, ["stream_id"], ORDER).withColumn("id", F.xxhash64("stream_id", "seq").bitwiseAND((1 << 61) - 1))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """Builds the graph and writes what is asked for; returns nodes and edges."""
    p = parser()
    args = p.parse_args(argv)
    formats = formats_of(args)
    if formats and not args.output:
        p.error("an output folder is needed: -o FOLDER")
    spark = spark or SparkSession.builder.appName("waymesh").getOrCreate()
    config, points = config_of(spark, args), points_of(spark, args)
    if args.stops:
        nodes, edges = graph.build_path_graph(points, KEYS, ORDER, config)
    else:
        nodes, edges = graph.build_graph(points, KEYS, ORDER, config, id="id", spikes=args.filter_spikes)
    if formats:
        sinks.write_graph(nodes, edges, args.output, formats)
    else:
        print("Nothing is written. See --help.")
    return nodes, edges
