"""Writers of a graph: Parquet tables, CSV, JSON lines and DOT.

Every writer is distributed; each format is a folder of part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bbox, geo

FORMATS = ("parquet", "nodes_csv", "edges_csv", "json", "dot")


def node_table(nodes: DataFrame) -> DataFrame:
    """label, weight, x1, y1, t1, x2, y2, t2: numbers as plain digits."""
    sides = ("x1", "y1", "t1", "x2", "y2", "t2")
    return nodes.select(F.col("node_id").cast("string").alias("label"), "weight", *(geo.plain_number(F.col("bbox")[s]).alias(s) for s in sides))


def edge_table(edges: DataFrame) -> DataFrame:
    """A row a point of every edge: edge_id, src, dst, weight, pos, x, y, t."""
    rows = edges.select("edge_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight", F.posexplode("trj").alias("pos", "p"))
    return rows.select("edge_id", "src", "dst", "weight", "pos", *(geo.plain_number(F.col("p")[c]).alias(c) for c in "xyt"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, value``: the lines of a digraph; part orders head, nodes, edges and tail."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "digraph {"), (3, "}")], "part int, value string")
    own = nodes.select(F.lit(1).alias("part"), F.format_string('    "%s"', F.col("node_id").cast("string")).alias("value"))
    ways = edges.select(F.lit(2).alias("part"), F.format_string('    "%s" -> "%s" [ label = "%s" ]', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("edge_id").cast("string")).alias("value"))
    return frame.unionByName(own).unionByName(ways)


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: an object a node and an object an edge, told apart by ``kind``; nodes of a path graph say whether they are roots."""
    sides = [F.col("bbox")[s].alias(s) for s in bbox.SIDES]
    root = ["is_root"] if "is_root" in nodes.columns else []
    own = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("id"), "weight", *root, F.struct(*sides).alias("bbox"))).alias("value"))
    ways = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight", "trj")).alias("value"))
    return own.unionByName(ways)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",), mode: str = "error") -> None:
    """Writes each of ``formats`` below ``path``; DOT lines are sorted by part."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    if "parquet" in formats:
        nodes.write.mode(mode).parquet(f"{path}/nodes")
        edges.write.mode(mode).parquet(f"{path}/edges")
    if "nodes_csv" in formats:
        node_table(nodes).write.mode(mode).csv(f"{path}/nodes_csv", header=True)
    if "edges_csv" in formats:
        edge_table(edges).write.mode(mode).csv(f"{path}/edges_csv", header=True)
    if "json" in formats:
        json_lines(nodes, edges).write.mode(mode).text(f"{path}/graph_json")
    if "dot" in formats:
        # a range by part and text: file after file is the whole digraph
        dot_lines(nodes, edges).orderBy("part", "value").select("value").write.mode(mode).text(f"{path}/graph_dot")
