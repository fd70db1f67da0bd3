"""Work on grids by tiles: each task gets a core with a halo around it, and gives the core's cells alone.

A cell goes to every tile whose halo holds it, so one shuffle replaces the row and column windows of a whole grid, and no
task holds more than (core + 2 * reach) ** 2 cells, however large a scene is. Tiles without cells do not exist.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import grid
from tidegrid.params import Window as Half

#: Rows and columns of a tile's core: with a reach of 50 some 250 000 cells a task.
CORE = 400
KINDS = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def exchanged(cells: DataFrame, core: int, reach: tuple[int, int]) -> DataFrame:
    """cells with tr and tc: a row for every tile whose core, widened by reach, holds the cell; `own` in its own tile."""
    if core < 1 or min(reach) < 0:
        raise ValueError("a tile needs a core of one cell or more, and a reach of none or more")
    tile = lambda c: F.floor(F.col(c) / core).cast("int")
    around = lambda c, n: F.sequence(F.floor((F.col(c) - n) / core).cast("int"), F.floor((F.col(c) + n) / core).cast("int"))
    rows = cells.withColumn("tr", F.explode(around("r", reach[0])))
    return rows.withColumn("tc", F.explode(around("c", reach[1]))).withColumn("own", (F.col("tr") == tile("r")) & (F.col("tc") == tile("c")))


def tiled(cells: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], made: dict[str, str], core: int = CORE, reach: tuple[int, int] = (0, 0), key: str = "g", needs: tuple[str, ...] = ()) -> DataFrame:
    """cells with the columns `made` (name: kind, one of KINDS), by a kernel of whole tiles.

    The kernel gets a dense array, core and halo, for each column in `needs` (NaN where there is no cell or no value), and gives one of the
    same shape for each name in `made`. A cell (key, r, c) that occurs twice is refused. Columns beyond needs go along with the core.
    """
    names = cells.columns
    fields = {f.name: f.dataType.simpleString() for f in cells.schema}
    height, width = core + 2 * reach[0], core + 2 * reach[1]

    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy(zero_copy_only=False)
        r = table["r"].to_numpy().astype(np.int64) - (table["tr"][0].as_py() * core - reach[0])
        c = table["c"].to_numpy().astype(np.int64) - (table["tc"][0].as_py() * core - reach[1])
        at = r * width + c
        if len(np.unique(at)) < len(at):
            raise ValueError("a grid has one row for each cell")
        arrays = {}
        for name in needs if own.any() else ():
            dense = np.full(height * width, np.nan)
            dense[at] = table[name].to_numpy(zero_copy_only=False).astype(float)
            arrays[name] = dense.reshape(height, width)
        out = kernel(arrays) if own.any() else {name: np.zeros(height * width) for name in made}
        rows = table.filter(pa.array(own)).select(names)
        for name in made:
            rows = rows.append_column(name, pa.array(out[name].reshape(-1)[at[own]], from_pandas=True).cast(KINDS[made[name]]))
        return rows

    schema = ", ".join(f"`{x}` {k}" for x, k in (fields | made).items())
    dealt = exchanged(cells, core, reach).where(F.col(key).isNotNull())
    return dealt.groupBy(key, "tr", "tc").applyInArrow(run, schema)


def boxes(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over the (2h+1) x (2w+1) box around each cell, clipped to the array, by prefix sums of rows and then of columns."""
    for axis, k in ((0, h), (1, w)):
        n = values.shape[axis]
        sums = np.concatenate([np.zeros_like(values.take([0], axis)), np.cumsum(values, axis)], axis)
        to, start = np.minimum(np.arange(n) + k + 1, n), np.maximum(np.arange(n) - k, 0)
        values = sums.take(to, axis) - sums.take(start, axis)
    return values


def training(cells: DataFrame, p: Half, core: int = CORE, key: str = "g", mask: str | None = None) -> DataFrame:
    """cells with power (null where invalid) and n, s, q: count, sum and sum of squares of valid power in the background without the guard.

    The same numbers as `grid.training` gives for these cells, by one shuffle in place of four and without a dense grid. Where a
    Boolean column `mask` is named, cells for which it isn't true are as invalid ones: neither analysed nor part of a background.
    """
    hv = F.col("hv") if mask is None else F.when(F.col(mask), F.col("hv"))
    rows = grid.prepared(cells.withColumn("_hv", F.col("hv")).withColumn("hv", hv), p).drop("one", "square").withColumn("hv", F.col("_hv")).drop("_hv")

    def kernel(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        power = arrays["power"]
        ok = np.isfinite(power)
        power = np.where(ok, power, 0.0)
        of = lambda v: boxes(v, *p.background) - boxes(v, *p.guard)
        return {"n": np.rint(of(ok.astype(float))), "s": of(power), "q": of(power * power)}

    return tiled(rows, kernel, {"n": "double", "s": "double", "q": "double"}, core, p.background, key, ("power",))
