"""A movement graph kept up to date as trips are closed.

A ``GraphStore`` is a folder of tables, each a Parquet folder a version, and a version a
batch.  A batch brings trips; their ends are clustered with the stored ends of the
cells around them alone, and clusters that they join are united under the least
name.  What changed are the places that got an end, or a new name: only for these
are members, cuts, slices and the representatives of their edges made anew and
written as rows of the batch's version.  A row counts as long as no later version
has touched its place (of an edge: either place).

A batch whose version is committed is passed over, and what an attempt that failed
has left is overwritten, so a repeated batch changes nothing.  After any number of
batches the graph equals ``build_graph`` of all trips at once.

Work of a batch follows the batch and the places that it touches, apart from
finding current rows, which reads the narrow tables of places and versions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import bbox, geo
from ..operators import cluster, segment, split
from ..operators.components import connected_components
from ..plans import graph
from ..shared import scratch, written

_SIDES = ("src", "dst")


def trips_of_batch(batch: DataFrame, key: str = "stream_id") -> DataFrame:
    """Rows of ``trips_stream`` as trips: a name from stream, day and first time, and both ends."""
    own = batch.where("kind = 'trip'")
    name = F.pmod(F.xxhash64(F.col(key).cast("string"), "day", F.col("trj")[0]["t"]), F.lit(1 << 61))
    return own.select(name.alias("trj_id"), F.col("trj")[0].alias("start"), F.element_at("trj", -1).alias("end"), "trj")


class GraphStore:
    """Tables of a graph at ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config

    def versions(self) -> list[int]:
        """Committed batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str, versions: list[int]) -> DataFrame | None:
        if not versions:
            return None
        parts = self.spark.read.option("basePath", f"{self.folder}/{name}")
        return parts.parquet(*(f"{self.folder}/{name}/version={v}" for v in versions)).withColumn("version", F.col("version").cast("long"))

    def _write(self, name: str, version: int, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _current(self, name: str, versions: list[int], *places: str) -> DataFrame | None:
        """Rows that no later version has touched by any of their ``places``."""
        rows = self._read(name, versions)
        if rows is None:
            return None
        last = self._read("touched", versions).groupBy("place").agg(F.max("version").alias("last"))
        for p in places:
            rows = rows.join(last.select(F.col("place").alias(p), F.col("last").alias(f"last_{p}")), p, "left")
        newest = F.greatest(*(F.coalesce(f"last_{p}", "version") for p in places)) if len(places) > 1 else F.coalesce(f"last_{places[0]}", "version")
        return rows.where(newest <= F.col("version")).drop("version", *(f"last_{p}" for p in places))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as ``build_graph`` returns them."""
        versions = self.versions()
        nodes, edges = self._current("nodes", versions, "place"), self._current("edges", versions, "src_place", "dst_place")
        if nodes is None:
            raise ValueError(f"{self.folder} has no committed batch")
        return nodes, edges.drop("src_place", "dst_place")

    def _members(self, ends: DataFrame, before: list[int]) -> tuple[DataFrame, DataFrame]:
        """Ends of the touched places with these, and (old, place) of the stored places that were touched."""
        threshold, slack = self.config.clustering_threshold, self.config.temporal_slack_ms
        cell = lambda a=0, b=0: F.struct((F.floor(F.col("x") / threshold) + a).alias("cx"), (F.floor(F.col("y") / threshold) + b).alias("cy"))
        stored = self._current("members", before, "place")
        links = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        if stored is None:
            found = cluster.cluster_endpoints(ends, threshold, slack)
            own = ends.join(found, "ep_id").withColumnRenamed("cluster_id", "place")
            return own, own.select(F.col("place").alias("old"), "place").limit(0)
        around = ends.select(F.explode(F.array(*(cell(a, b) for a, b in links))).alias("cell")).distinct()
        near = written(stored.withColumn("cell", cell()).join(around, "cell", "left_semi").drop("cell"), "near")
        points = ["ep_id", "x", "y", "t"]
        pairs = cluster.cell_links(ends.select(points).union(near.select(points)), threshold, geo.time_weight(slack))
        known = near.select(F.col("ep_id").alias("i"), F.col("place").alias("j"))
        found = written(connected_components(pairs.select("i", "j").union(known), "i", "j"), "found")
        new = ends.join(found.withColumnRenamed("id", "ep_id"), "ep_id", "left").withColumn("place", F.coalesce("component", "ep_id")).drop("component")
        new = written(new, "new-members")
        named = found.withColumnRenamed("id", "old").withColumnRenamed("component", "place")
        old = near.select(F.col("place").alias("old")).distinct().join(named, "old", "left").withColumn("place", F.coalesce("place", "old"))
        old = written(old.join(new.select("place").distinct(), "place", "left_semi").select("old", "place"), "old-places")
        moved = stored.withColumnRenamed("place", "old").join(old, "old").select(*new.columns)
        return new.unionByName(moved), old

    def apply(self, trips: DataFrame, batch: int) -> bool:
        """Adds ``trips`` (trj_id, start, end, trj) as version ``batch``; False if that is there already."""
        done = self.versions()
        if batch in done:
            return False
        before, now = [v for v in done if v != batch], [*done, batch]
        with scratch(self.spark):
            trips = self._write("trips", batch, trips.select("trj_id", "start", "end", "trj"))
            ends = written(segment.endpoints(trips), "ends")
            members, old = self._members(ends, before)
            members = self._write("members", batch, members)
            places = written(members.select("place").distinct(), "places")
            self._write("touched", batch, places.union(old.select("old")).distinct().select("place"))
            ways = self._write("ways", batch, self._ways(ends, members, old, before))
            trj = self._read("trips", now).select(F.col("trj_id").alias("edge_id"), "trj")
            edges = written(graph.lasting(ways.join(trj, "edge_id").withColumn("weight", F.lit(1)).select("edge_id", "src", "dst", "weight", "trj")), "edges")
            touched = places.withColumnRenamed("place", "node_id")
            cuts = self._write("cuts", batch, split.cut_rows(edges).join(touched, "node_id", "left_semi").withColumnRenamed("node_id", "place"))
            used = edges.select(F.col("src").alias("place")).union(edges.select(F.col("dst").alias("place"))).distinct()
            every = written(self._current("cuts", now, "place").join(used, "place", "left_semi").withColumnRenamed("place", "node_id"), "cuts")
            moved = written(split.split_edges(edges, every), "moved")
            self._write("nodes", batch, self._slices(members, cuts, moved, touched))
            name = lambda n: F.concat_ws(":", F.col(n).cast("string"), F.col(f"{n}_slice").cast("string")).alias(n)
            named = written(moved.select("edge_id", name("src"), name("dst"), "weight", "trj"), "named")
            place = lambda n: F.split(n, ":")[0].cast("long").alias(f"{n}_place")
            self._write("edges", batch, graph.representatives(named, self.config).select("*", *map(place, _SIDES)))
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")
        return True

    def _ways(self, ends: DataFrame, members: DataFrame, old: DataFrame, before: list[int]) -> DataFrame:
        """edge_id, src and dst of all edges at a touched place, by today's names."""
        at = members.join(ends.select("ep_id"), "ep_id", "left_semi")
        side = lambda end: F.max(F.when(F.col("is_end") == end, F.col("place")))
        new = at.groupBy(F.col("trj_id").alias("edge_id")).agg(side(False).alias("src"), side(True).alias("dst"))
        stored = self._current("ways", before, *_SIDES)
        if stored is None:
            return new
        for s in _SIDES:
            stored = stored.join(old.select(F.col("old").alias(s), F.col("place").alias(f"new_{s}")), s, "left")
        hit = stored.where("new_src is not null or new_dst is not null")
        return new.unionByName(hit.select("edge_id", *(F.coalesce(f"new_{s}", s).alias(s) for s in _SIDES)))

    def _slices(self, members: DataFrame, cuts: DataFrame, moved: DataFrame, touched: DataFrame) -> DataFrame:
        """Nodes (slices) of the touched places, as ``make_monotone`` makes them."""
        places = members.groupBy(F.col("place").alias("node_id")).agg(F.count("*").cast("int").alias("weight"), bbox.of_rows("x", "y", "t").alias("bbox"))
        ends = reduce(DataFrame.unionByName, (moved.select(F.col(s).alias("node_id"), F.col(f"{s}_slice").alias("slice")) for s in _SIDES))
        used = ends.join(touched, "node_id", "left_semi").groupBy("node_id", "slice").agg(F.count("*").alias("slice_weight"))
        boxes = split.split_boxes(places, cuts.withColumnRenamed("place", "node_id"))
        found = boxes.join(used, ["node_id", "slice"])
        return found.select(
            F.concat_ws(":", F.col("node_id").cast("string"), F.col("slice").cast("string")).alias("node_id"), F.col("node_id").alias("place"), "slice", "weight", "bbox", "slice_weight"
        )

