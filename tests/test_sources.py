"""Readers, writers and streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymesh import cli
from waymesh.config import Config
from waymesh.plans import graph
from waymesh.sources import readers, sinks
from waymesh.streaming import forms

GPX = """<gpx><trk><trkseg>
<trkpt lat="55.5" lon="10.25"><ele>1.5</ele><time>2020-01-01T00:00:01.500Z</time></trkpt>
<trkpt lon="-10.25" lat="-55.5"><time>2020-01-01T00:00:02Z</time></trkpt>
<trkpt lat="89.5" lon="1.0"><ele>1.0</ele><time>2020-01-01T00:00:03.000Z</time></trkpt>
<trkpt lat="x" lon="1.0"><ele>1.0</ele><time>2020-01-01T00:00:03.000Z</time></trkpt>
</trkseg></trk></gpx>"""
PLT = "Geolife trajectory\nWGS 84\n0,2,255,My Track,0,0,2,8421376\n39.9,116.3,0,492,39744.1,2008-10-23,02:53:04.5\nnan,1,0,0,39744,x,01:00:00\n"
AIS = "mmsi_number,time,longitude,latitude,heading,speed,cog,rot,shipcode\n7,2009-02-01 00:00:01,-4.5,48.3,1,1,1,1,1\n8,2009-02-01 00:00:02,-4.6,48.4,1,1,1,1,1\n8,bad,-4.6,48.4,1\n"
SYN = ",latitude,longitude,uid,anom_start\n2020-01-01 23:59:59.999,1.5,2.5,a,\n2020-01-02 00:00:00.001,1.5,2.5,b,\n"


def test_readers(spark, tmp_path):
    for name, text in (("a.gpx", GPX), ("b.plt", PLT), ("c.csv", AIS), ("d.csv", SYN), ("e.txt", "")):
        (tmp_path / name).write_text(text)
    files = readers.text_files(spark, str(tmp_path))
    rows = readers.read_points(files).collect()
    got = sorted((r.source[-5:], r.seq, str(r.day), r.lat, r.lon, r.t_ms) for r in rows)
    assert got == [
        ("a.gpx", 0, "2020-01-01", 55.5, 10.25, 1500), ("a.gpx", 1, "2020-01-01", -55.5, -10.25, 2000),
        ("b.plt", 3, "2008-10-23", 39.9, 116.3, 10384500),
        ("c.csv", 1, "2009-02-01", 48.3, -4.5, 1000), ("c.csv", 2, "2009-02-01", 48.4, -4.6, 2000),
        ("d.csv", 1, "2020-01-01", 1.5, 2.5, 86399999), ("d.csv", 2, "2020-01-02", 1.5, 2.5, 1),
    ]
    assert len({r.stream_id for r in rows if r.source.endswith("c.csv")}) == 2
    merged = readers.read_ais(readers.sniffed(files).where("format = 'ais'"), ignore_ids=True).collect()
    assert len({r.stream_id for r in merged}) == 1
    strict = readers.read_gpx(readers.sniffed(files).where("format = 'gpx'"), strict=True).collect()
    assert [(r.seq, r.t_ms) for r in strict] == [(0, 1500)]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("1:0", 2, (0.0, 12345678.5, 0.0, 1.0, 0.0, 5.0))], "node_id string, weight int, bbox struct<x1:double,x2:double,y1:double,y2:double,t1:double,t2:double>")
    edges = spark.createDataFrame([(4, "1:0", "1:1", 3, [(0.0, 1.0, 2.0), (1.5, 1.0, 3.0)])], "edge_id long, src string, dst string, weight int, trj array<struct<x:double,y:double,t:double>>")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"), sinks.FORMATS)
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1
    assert spark.read.csv(str(tmp_path / "g/nodes_csv"), header=True).first().x2 == "12345678.5"
    assert [r.x for r in spark.read.csv(str(tmp_path / "g/edges_csv"), header=True).orderBy("pos").collect()] == ["0", "1.5"]
    assert {r.kind for r in spark.read.json(str(tmp_path / "g/graph_json")).collect()} == {"node", "edge"}
    told = [r.value for r in sinks.json_lines(nodes.withColumn("is_root", F.lit(True)), edges).collect()]
    assert sum('"is_root":true' in v for v in told) == 1 and not any("is_root" in r.value for r in sinks.json_lines(nodes, edges).collect())
    text = [r.value for r in spark.read.text(str(tmp_path / "g/graph_dot")).collect()]
    assert text[0] == "digraph {" and text[-1] == "}" and '"1:0" -> "1:1"' in text[2]
    with pytest.raises(ValueError):
        sinks.write_graph(nodes, edges, str(tmp_path / "h"), ("pdf",))


def test_lines_of_large_files(spark, tmp_path):
    """Read in small splits, each format gives the same points in the same order as read whole."""
    at = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=7 * i)
    texts = {
        "gpx": "<gpx>\n" + "\n".join(f'<trkpt lat="{55 + i / 1e4}" lon="10.5">\n<ele>1.0</ele><time>{at(i).isoformat()}.000Z</time></trkpt>' for i in range(400)) + "\n</gpx>",
        "plt": PLT + "".join(f"{39 + i / 1e4},116.3,0,492,{39744 + i // 300},x,{at(i):%H:%M:%S}\n" for i in range(400)),
        "ais": AIS + "".join(f"{i % 3},{at(i):%Y-%m-%d %H:%M:%S},-4.5,{48 + i / 1e4},1,1,1,1,1\r\n" for i in range(400)),
        "synthetic": SYN + "".join(f"{at(i):%Y-%m-%d %H:%M:%S},{1 + i / 1e4},2.5,u{i % 2},\n" for i in range(400)),
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        for kind, text in texts.items():
            folder = tmp_path / kind
            folder.mkdir()
            for name in ("a", "b"):
                (folder / name).write_text(text)
            key = lambda rows: [(r.source[-1], r.stream_id[-1], str(r.day), r.lat, r.lon, r.t_ms) for r in sorted(rows, key=lambda r: (r.source, r.seq))]
            lines = readers.read_lines(spark, str(folder), kind)
            assert lines.rdd.getNumPartitions() > 4
            assert key(lines.collect()) == key(readers.read_points(readers.text_files(spark, str(folder))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        readers.read_lines(spark, str(tmp_path), "pdf")


def test_command_line(spark, tmp_path):
    """Two trips each way between two places."""
    lines = [readers.AIS_HEADER]
    for vessel in range(4):
        for k in range(6):
            lon = -4.5 + (0.01 * k if vessel % 2 else 0.05 - 0.01 * k)
            lines.append(f"{vessel},2009-02-01 {vessel + 1:02d}:{k:02d}:00,{lon},48.3,1,1,1,1,1")
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "config.json").write_text('{"connection_timeout": 600000, "unknown": 1}')
    path = str(tmp_path / "in.csv")
    with pytest.raises(SystemExit):
        cli.main([path, "--nodes"], spark)
    for more in ([], ["--format", "ais"]):
        out = str(tmp_path / f"out{len(more)}")
        nodes, edges = cli.main([path, "-o", out, "-n", "-e", "-d", "-j", "-p", "-c", str(tmp_path / "config.json"), "-t", "24h", "-M", *more], spark)
        assert edges.count() == 4 and edges.agg(F.sum("weight")).first()[0] == 4
        assert spark.read.parquet(f"{out}/edges").count() == 4 and spark.read.text(f"{out}/graph_dot").count() == nodes.count() + 6
    assert cli.config_of(spark, cli.parser().parse_args([path, "-t", "15m", "-C", "--clustering-threshold", "20"])).temporal_slack_ms == 900_000


@pytest.mark.parametrize("strict", [False, True])
def test_mixed_files_are_read_once(spark, tmp_path, strict):
    """Files of all formats in one pass: a branch a format read, and split, every file four times over."""
    gpx = '<trkpt lat="1.5" lon="2.5"><ele>1.0</ele><time>2024-01-02T03:04:05.006Z</time></trkpt>'
    texts = {
        "a": "<gpx>" + gpx + "\n" + gpx + "</gpx>", "b": "Geolife trajectory\nh\n1.5,2.5,0,9,45293,2024-01-02,03:04:05",
        "c": f"{readers.AIS_HEADER}\r\n7,2024-01-02 03:04:05,2.5,1.5,1\r\nx", "d": f"{readers.SYNTHETIC_HEADER}\n2024-01-02 03:04:05,1.5,2.5,8,\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    points = readers.read_points(readers.text_files(spark, str(tmp_path)), strict_gpx=strict)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    rows = sorted((r.source[-1], r.seq, r.stream_id.split("#")[-1][-1], str(r.day), r.lat, r.lon, r.t_ms) for r in points.collect())
    t = 11_045_000
    assert rows == [(n, k, i, "2024-01-02", 1.5, 2.5, t + ms) for n, k, i, ms in (("a", 0, "a", 6), ("a", 1, "a", 6), ("b", 2, "b", 0), ("c", 1, "7", 0), ("d", 1, "8", 0))]
