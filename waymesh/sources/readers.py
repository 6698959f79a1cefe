"""Readers of GPS texts: GPX, PLT, AIS and plain CSV, told apart by their first line.

Each returns the rows ``source, stream_id, day, seq, lat, lon, x, y, t_ms``.
Rows whose position or time can't be read go; so do latitudes beyond
``MAX_LATITUDE``, where the projection runs off.  Vessel and user ids name the
streams unless ``ignore_ids`` merges a file's rows into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

MAX_LATITUDE = 88.0
#: First lines, trimmed and lower-cased (fixed values of the formats).
PLT_HEADER = "geolife trajectory"
AIS_HEADER = "mmsi_number,time,longitude,latitude,heading,speed,cog,rot,shipcode"
SYNTHETIC_HEADER = ",latitude,longitude,uid,anom_start"

COLUMNS = ["source", "stream_id", "day", "seq", "lat", "lon", "x", "y", "t_ms"]

_TRKPT = r"(?s)<trkpt\s+([^>]*)>(.*?)</trkpt>"
_STRICT_TRKPT = (
    r'(?s)<trkpt lat="(\d+\p{Punct}\d+)" lon="(\d+\p{Punct}\d+)">\s*<ele>-?\d+\.\d+</ele>\s*'
    r"<time>(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)\.(\d+)Z?</time>"
)


#: Formats that ``read_lines`` takes: files are read by line, or by track point, and large ones are split.
LINE_FORMATS = ("gpx", "plt", "ais", "synthetic")


def text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, value``: one row a file with its whole text, for files of mixed formats that fit a row each; ``read_lines`` takes larger ones."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")


def sniffed(files: DataFrame) -> DataFrame:
    """``files`` with ``format``: plt, ais, synthetic or gpx; files without text go."""
    first = F.lower(F.trim(F.regexp_extract("value", r"(?s)\A(.*?)(?:\r?\n|\z)", 1)))
    kind = F.when(first == PLT_HEADER, "plt").when(first == AIS_HEADER, "ais").when(first == SYNTHETIC_HEADER, "synthetic").otherwise("gpx")
    return files.where(F.trim("value") != "").withColumn("format", kind)


def _clock_ms(text: Column) -> Column:
    """``H:M:S`` with an optional fraction as whole ms since midnight; null if it isn't one."""
    part = lambda k: F.try_element_at(F.split(text, ":"), F.lit(k)).try_cast("double")
    h, m, s = part(1), part(2), part(3)
    ok = h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 60)
    return F.when(ok, F.floor(F.round((h * 3600 + m * 60 + s) * 1000, 3))).cast("bigint")


def _points(rows: DataFrame) -> DataFrame:
    """Rows source, stream_id, day, seq, lat, lon, t_ms: the valid ones, projected."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.where(finite("lat") & finite("lon") & F.col("t_ms").isNotNull() & F.col("day").isNotNull() & (F.abs("lat") <= MAX_LATITUDE))
    return good.withColumn("x", geo.mercator_x("lon")).withColumn("y", geo.mercator_y("lat")).select(*COLUMNS)


def _parsed(rows: DataFrame, texts: Column) -> DataFrame:
    """The points of rows source, seq; ``texts`` is a struct of stream_id, day, clock, ms, lat and lon (clock, lat and lon as they are written).

    A generator makes its row once, whatever later filters ask of it; a projection would be repeated in each of them.
    """
    once = lambda df, row: df.select("source", F.col("seq").cast("bigint").alias("seq"), F.inline(F.array(row)))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return _points(once(once(rows, texts), F.struct("stream_id", "day", number("lat"), number("lon"), (_clock_ms(F.col("clock")) + F.col("ms")).alias("t_ms"))))


def _lines(files: DataFrame) -> DataFrame:
    """source, seq and fields of each line after the first."""
    lines = files.select("source", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    return lines.where("seq > 0").select("source", "seq", F.split("line", ",").alias("f"))


def _split_lines(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """``source, seq, value`` of each line of files of any size, which are read in splits.

    ``seq`` grows along a file: the first byte of the split plus the row in its
    task, which can't pass the next split's first byte, as every line has one byte
    at least and a split that is not its file's last is alone in its task.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("source"), (F.col("_metadata.file_block_start") + row).alias("seq"), "value")


def read_lines(spark: SparkSession, paths: str | list[str], format: str, *, ignore_ids: bool = False, strict_gpx: bool = False) -> DataFrame:
    """The points of files that are all of one of ``LINE_FORMATS``; ``seq`` orders a file's points, but doesn't count them.

    Header lines go by themselves: they hold no position.
    """
    if format == "gpx":
        parts = _split_lines(spark, paths, "</trkpt>").withColumn("value", F.concat("value", F.lit("</trkpt>")))
        own = read_gpx(parts.withColumn("source", F.struct("source", F.col("seq").alias("part"))), strict=strict_gpx)
        named = own.withColumn("seq", F.col("source.part")).withColumn("source", F.col("source.source"))
        return named.withColumn("stream_id", F.col("source")).select(*COLUMNS)
    if format not in LINE_FORMATS:
        raise ValueError(f"unknown format: {format}")
    lines = _split_lines(spark, paths).select("source", "seq", F.split(F.regexp_replace("value", r"\r$", ""), ",").alias("f"))
    return _plt_points(lines) if format == "plt" else _stamped_points(lines, format, ignore_ids)


def _field(k: int) -> Column:
    return F.trim(F.try_element_at("f", F.lit(k + 1)))


def _texts(day: Column, clock: Column, lat: Column, lon: Column, stream: Column | str = "source", ms: Column | None = None) -> Column:
    return F.struct(
        (F.col(stream) if isinstance(stream, str) else stream).alias("stream_id"), day.alias("day"), clock.alias("clock"),
        (F.lit(0).cast("bigint") if ms is None else ms).alias("ms"), lat.alias("lat"), lon.alias("lon"),
    )


def _gpx_records(strict: bool) -> Column:
    """The track points of a text, each as its own text."""
    return F.regexp_extract_all("value", F.lit(_STRICT_TRKPT if strict else _TRKPT), F.lit(0))


def _gpx_texts(strict: bool) -> Column:
    """Of ``head`` and ``body``, or if ``strict`` of the track point in ``value``."""
    if strict:
        part = lambda k: F.regexp_extract("value", _STRICT_TRKPT, k)
        number = lambda k: F.regexp_replace(part(k), r"\p{Punct}", ".")
        return _texts(part(3).try_cast("date"), part(4), number(1), number(2), ms=part(5).try_cast("bigint"))
    number = lambda name: F.regexp_extract("head", rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    stamp = lambda k: F.regexp_extract("body", r"<time>\s*(\d{4}-\d\d-\d\d)T([0-9:.]+)", k)
    return _texts(stamp(1).try_cast("date"), stamp(2), number("lat"), number("lon"))


def _with_parts(rows: DataFrame) -> DataFrame:
    """``head`` (the attributes) and ``body`` of the track point in ``value``."""
    return rows.withColumns({name: F.regexp_extract("value", _TRKPT, k) for k, name in enumerate(("head", "body"), 1)})


def read_gpx(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """Track points with a sign, in any order of attributes, with or without ``ele`` and fraction.

    ``strict`` takes unsigned positions only, wants both, and reads a fraction's digits as milliseconds.
    """
    rows = files.select("source", F.posexplode(_gpx_records(strict)).alias("seq", "value"))
    return _parsed(rows if strict else _with_parts(rows), _gpx_texts(strict))


def _plt_texts() -> Column:
    day = F.date_add(F.lit("1899-12-30").cast("date"), _field(4).try_cast("double").cast("int"))
    return _texts(day, _field(6), _field(0), _field(1))


def _plt_points(lines: DataFrame) -> DataFrame:
    return _parsed(lines, _plt_texts())


#: Fields of id, time, latitude and longitude.
_FIELDS = {"ais": (0, 1, 3, 2), "synthetic": (3, 0, 1, 2)}


def _stamped_texts(format: str, ignore_ids: bool) -> Column:
    id, stamp, lat, lon = _FIELDS[format]
    parts = F.split(_field(stamp), r"[ T]")
    stream = F.col("source") if ignore_ids else F.concat_ws("#", "source", _field(id))
    return _texts(F.try_element_at(parts, F.lit(1)).try_cast("date"), F.try_element_at(parts, F.lit(2)), _field(lat), _field(lon), stream)


def _stamped_points(lines: DataFrame, format: str, ignore_ids: bool) -> DataFrame:
    return _parsed(lines, _stamped_texts(format, ignore_ids))


def read_plt(files: DataFrame) -> DataFrame:
    """Fields 0 latitude, 1 longitude, 4 day number since 1899-12-30, 6 time of day."""
    return _plt_points(_lines(files))


def read_ais(files: DataFrame, *, ignore_ids: bool = False) -> DataFrame:
    """Fields 0 vessel, 1 time, 2 longitude, 3 latitude."""
    return _stamped_points(_lines(files), "ais", ignore_ids)


def read_synthetic(files: DataFrame, *, ignore_ids: bool = False) -> DataFrame:
    """Fields 0 time, 1 latitude, 2 longitude, 3 user."""
    return _stamped_points(_lines(files), "synthetic", ignore_ids)


def read_points(files: DataFrame, *, ignore_ids: bool = False, strict_gpx: bool = False) -> DataFrame:
    """The points of files of any format, each read by its own in one pass over all files."""
    is_gpx = F.col("format") == "gpx"
    records = F.when(is_gpx, _gpx_records(strict_gpx)).otherwise(F.split("value", r"\r?\n"))
    rows = sniffed(files).select("source", "format", F.posexplode(records).alias("seq", "value")).where(is_gpx | (F.col("seq") > 0))
    rows = rows.withColumn("f", F.when(~is_gpx, F.split("value", ",")))
    if not strict_gpx:
        rows = rows.withColumns({name: F.when(is_gpx, F.regexp_extract("value", _TRKPT, k)) for k, name in enumerate(("head", "body"), 1)})
    texts = F.when(is_gpx, _gpx_texts(strict_gpx)).when(F.col("format") == "plt", _plt_texts())
    for format in _FIELDS:
        texts = texts.when(F.col("format") == format, _stamped_texts(format, ignore_ids))
    return _parsed(rows, texts)
