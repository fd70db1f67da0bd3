"""Scenes as tiles: a Python data source over array archives, and checks on scan."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BANDS = ("hv", "hh", "incidence", "lat", "lon")
REQUIRED = ("hv", "hh", "incidence", "zone")


class Block(InputPartition):
    def __init__(self, path: str, r0: int, rows: int, cols: int):
        self.path, self.r0, self.rows, self.cols = path, r0, rows, cols


class SceneReader(DataSourceReader):
    """One partition for each stripe of tiles; an archive's arrays are mapped, so a task reads only its rows."""

    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tile", 256))
        self.skip = options.get("skipCorrupt", "false").lower() == "true"

    def partitions(self) -> list[Block]:
        out = []
        for folder in sorted(glob.glob(os.path.join(self.path, "*", ""))):
            try:
                shapes = {b: np.load(os.path.join(folder, f"{b}.npy"), mmap_mode="r").shape for b in REQUIRED}
                if len(set(shapes.values())) != 1 or len(shapes["hv"]) != 2:
                    raise ValueError(f"bands of {folder} differ in shape")
            except (OSError, ValueError):
                if not self.skip:
                    raise
                continue
            rows, cols = shapes["hv"]
            out += [Block(folder, r, rows, cols) for r in range(0, rows, self.tile)]
        return out

    def read(self, part: Block) -> Iterator[tuple]:
        arrays = {}
        for b in (*BANDS, "zone"):
            at = os.path.join(part.path, f"{b}.npy")
            arrays[b] = np.load(at, mmap_mode="r") if os.path.exists(at) else None
        end = min(part.rows, part.r0 + self.tile)
        for c0 in range(0, part.cols, self.tile):
            c1 = min(part.cols, c0 + self.tile)
            cut = [None if arrays[b] is None else arrays[b][part.r0 : end, c0:c1].astype(float).ravel().tolist() for b in BANDS]
            zone = arrays["zone"][part.r0 : end, c0:c1].astype(int).ravel().tolist()
            yield (os.path.basename(part.path.rstrip("/")), part.r0 // self.tile, c0 // self.tile, part.r0, c0, end - part.r0, c1 - c0, *cut, zone)


class SceneSource(DataSource):
    """spark.read.format("scene_tiles").load(folder): a folder of scenes, each a folder of .npy bands."""

    @classmethod
    def name(cls) -> str:
        return "scene_tiles"

    def schema(self) -> str:
        return "scene_id string, tile_row int, tile_col int, r0 int, c0 int, h int, w int, " + ", ".join(f"{b} array<double>" for b in BANDS) + ", zone array<int>"

    def reader(self, schema) -> SceneReader:
        return SceneReader(self.options)


def unknown(value: Column, *fills: float) -> Column:
    """Fill values and NaN as null."""
    return F.when(~value.isin(*fills) & ~F.isnan(value), value)


def restored(value: Column, mean: float, deviation: float) -> Column:
    return value * deviation + mean


def pixels(tiles: DataFrame, fill: float = -9999.0) -> DataFrame:
    """One row for each cell of tiles, nodata as null."""
    zipped = F.arrays_zip(*(F.coalesce(F.col(b), F.array_repeat(F.lit(None).cast("double"), F.col("h") * F.col("w"))).alias(b) for b in BANDS), F.col("zone"))
    rows = tiles.select("scene_id", "r0", "c0", "w", F.posexplode(zipped).alias("k", "p"))
    at = [(F.col("r0") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("r"), (F.col("c0") + F.col("k") % F.col("w")).cast("int").alias("c")]
    return rows.select("scene_id", *at, *(unknown(F.col(f"p.{b}"), fill).alias(b) for b in BANDS), F.col("p.zone").alias("zone"))


def eligible(p: DataFrame) -> DataFrame:
    """Adds `valid`: both bands known, and an incidence between 0 and 90."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return p.withColumn("valid", known("hv") & known("hh") & known("incidence") & (F.col("incidence") > 0) & (F.col("incidence") < 90))


def extents(p: DataFrame) -> DataFrame:
    """Of each scene its bounds: the zone map that prunes scans."""
    return p.groupBy("scene_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def pruned(p: DataFrame, index: DataFrame, west: float, south: float, east: float, north: float, centre: bool = True) -> DataFrame:
    """Cells of scenes whose centre (or any part) is in a box, by a semi-join with the index."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    inside = mid("west", "east").between(west, east) & mid("south", "north").between(south, north) if centre else (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return p.join(index.where(inside).select("scene_id"), "scene_id", "left_semi")


def stack_faults(p: DataFrame, ratio: str = "ratio") -> DataFrame:
    """One row of counts against a band stack: ratio identity, angles, nodata that differs between bands."""
    nothing = sum((F.col(c).isNull().cast("int") for c in ("hv", "hh", "incidence")), F.lit(0))
    return p.agg(
        F.count_if(F.abs(F.col("hh") - F.col("hv") - F.col(ratio)) > 0.001).alias("ratio_off"), F.count_if((F.col("incidence") <= 0) | (F.col("incidence") >= 90)).alias("angle_off"), F.count_if((nothing > 0) & (nothing < 3)).alias("nodata_off"),
    )


def write_stack(p: DataFrame, path: str) -> None:
    """Write a checked stack once."""
    faults = stack_faults(p).first().asDict()
    if any(faults.values()):
        raise ValueError(f"the stack isn't sound: {faults}")
    p.write.mode("errorifexists").partitionBy("scene_id").parquet(path)
