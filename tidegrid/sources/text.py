"""Text sources: sightings tables, product annotations, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import clock

#: Headers that a field may have, in lower case without spaces.
ALIASES = {
    "d": ("sighting_date", "date"), "c": ("sighting_time", "time"), "lat": ("sighting_latitude", "latitude", "lat"), "lon": ("sighting_longitude", "longitude", "lon"),
    "number": ("iceberg_number", "number"), "year": ("iceberg_year", "year"), "size": ("size",), "shape": ("shape",), "source": ("source",), "method": ("sighting_method", "method"),
}
REQUIRED = ("d", "lat", "lon")


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of sightings with normalised fields; a required field must have exactly one of its headers.

    Rows that can't be read are left out; if none can, that is an error.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c: c.strip().lower().replace(" ", "_") for c in raw.columns}
    picked = {}
    for field, aliases in ALIASES.items():
        found = [c for c, n in names.items() if n in aliases]
        if len(found) > 1 or field in REQUIRED and not found:
            raise ValueError(f"{field}: {len(found)} columns match")
        if found:
            picked[field] = F.trim(F.col(f"`{found[0]}`"))
    rows = raw.select(*(v.alias(k) for k, v in picked.items()))
    rows = rows if "c" in picked else rows.withColumn("c", F.lit("0000"))
    out = sightings(rows.withColumn("lat", F.expr("try_cast(lat AS double)")).withColumn("lon", F.expr("try_cast(lon AS double)")))
    if not raw.isEmpty() and out.isEmpty():
        raise ValueError("no row could be read")
    return out


def sightings(raw: DataFrame, box: tuple[float, float, float, float] = (-65.0, 40.0, -40.0, 65.0)) -> DataFrame:
    """raw (d, c, lat, lon, ...) with day and clock; west longitudes given without a sign get it. Rows out of bounds go."""
    west, south, east, north = box
    day = F.coalesce(F.try_to_timestamp("d", F.lit("M/d/yyyy")), F.try_to_timestamp("d", F.lit("yyyy-M-d")))
    lon = F.when((F.col("lon") > 30) & (F.col("lon") < 80), -F.col("lon")).otherwise(F.col("lon"))
    rows = raw.withColumn("day", F.date_format(day, "yyyy-MM-dd")).withColumn("clock", clock(F.col("c"))).withColumn("lon", lon)
    return rows.where(F.col("day").isNotNull() & F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("d", "c")


def vectors(files: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """(file, line, pixel, value) of annotation XML (file, xml): every `item` has a line, pixels and as many values.

    fields: XPath of line, pixel and value inside the item. Unequal lengths are an error.
    """
    count = F.xpath_int("xml", F.lit(f"count({item})"))
    rows = files.select("file", "xml", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("i"))
    value = lambda k: F.split(F.trim(F.element_at(F.expr(f"xpath(xml, '{item}/{fields[k]}/text()')"), F.col("i"))), r"\s+")
    rows = rows.select("file", value("line")[0].cast("int").alias("line"), value("pixel").alias("p"), value("value").alias("v"))
    rows = rows.withColumn("v", F.when(F.size("p") == F.size("v"), F.col("v")).otherwise(F.raise_error(F.lit("pixels and values of unequal length"))))
    return rows.select("file", "line", F.inline(F.arrays_zip("p", "v"))).select("file", "line", F.col("p").cast("int").alias("pixel"), F.col("v").cast("double").alias("value"))


def first_vectors(files: DataFrame, choices: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """(file, line, pixel, value) by the first of `choices` (item, fields) that finds vectors in a file: newer tags before legacy ones."""
    found = None
    for item, fields in choices:
        rows = vectors(files, item, fields)
        found = rows if found is None else found.unionByName(rows.join(found.select("file").distinct(), "file", "left_anti"))
    return found


#: Element names of range noise, newer before legacy, and of calibration.
NOISE = [("//noiseRangeVector", {"line": "line", "pixel": "pixel", "value": "noiseRangeLut"}), ("//noiseVector", {"line": "line", "pixel": "pixel", "value": "noiseLut"})]
CALIBRATION = ("//calibrationVector", {"line": "line", "pixel": "pixel", "value": "sigmaNought"})


def orbit_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Fields of orbit file names: platform, kind, generated, begins, ends; names of another form have nulls."""
    pattern = r"^(S1[A-D])_OPER_AUX_(POEORB|RESORB)_OPOD_(\d{8}T\d{6})_V(\d{8}T\d{6})_(\d{8}T\d{6})"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    when = lambda k: F.try_to_timestamp(part(k), F.lit("yyyyMMdd'T'HHmmss"))
    return files.withColumns({"platform": part(1), "kind": part(2), "generated": when(3), "begins": when(4), "ends": when(5)})


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
