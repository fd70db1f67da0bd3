"""Jobs: whole runs over scenes, with a status row for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import grid, ledgers, screen, tiles
from tidegrid.params import Gates, Window


def detect(cells: DataFrame, p: Window | None = None, gates: Gates | None = None, kind: str = "gamma", min_pixels: int = 1) -> DataFrame:
    """Candidates of all grids (g) with metrics, clutter over their boxes and first_rejection: threshold, components, gates."""
    p = p or Window()
    if kind not in ("gamma", "cell_averaging"):
        raise ValueError(f"no detector is called {kind}")
    trained = ledgers_kept(tiles.training(grid.densify(cells), p))
    rows = grid.veto({"gamma": grid.gamma_threshold, "cell_averaging": grid.cell_averaging}[kind](trained, p))
    rows = ledgers_kept(rows.withColumn("clutter", 10 * F.log10(F.greatest("mean", F.lit(1e-12)))))
    labels = grid.label_components(rows.where("hit"))
    stats = grid.component_stats(labels.join(rows.select("g", "r", "c", "hv", "hh"), ["g", "r", "c"])).where(F.col("pixel_area") >= min_pixels)
    box = stats.select("g", "label", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select("g", "label", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    clutter = box.join(rows.select("g", "r", "c", "clutter"), ["g", "r", "c"]).groupBy("g", "label").agg(F.median("clutter").alias("clutter_db"))
    return screen.first_rejection(stats.join(clutter, ["g", "label"], "left").withColumn("length_m", F.col("major")).withColumn("width_m", F.col("minor")), gates)


def ledgers_kept(df: DataFrame) -> DataFrame:
    from tidegrid.operators.graph import kept

    return kept(df)


def benchmark(candidates: DataFrame, scenes: DataFrame, strata: Iterable[str], gates: Gates | None = None) -> dict[str, DataFrame]:
    """Ledger and a rollup by each stratum of judged candidates."""
    judged = screen.first_rejection(candidates, gates)
    results = screen.scene_results(judged, scenes)
    return {"ledger": screen.ledger(judged, gates)} | {s: screen.rollup(results, s) for s in strata}


def batch(spark: SparkSession, scenes: Iterable[str], one: Callable[[str], None], stored: DataFrame | None = None) -> DataFrame:
    """(scene, status, reason): each scene by itself; a failure is a row, not the end, and what is stored is left alone."""
    todo = spark.createDataFrame([(s,) for s in scenes], "scene string")
    new = todo if stored is None else ledgers.new_only(stored, todo, "scene")
    rows, left = [], {r.scene for r in new.select("scene").collect()}
    for scene in (r.scene for r in todo.collect()):
        if scene not in left:
            rows.append((scene, "stored", None))
            continue
        try:
            one(scene)
            rows.append((scene, "done", None))
        except Exception as e:  # noqa: BLE001  any failure of a scene is its status
            rows.append((scene, "failed", f"{type(e).__name__}: {e}"[:300]))
    return spark.createDataFrame(rows, "scene string, status string, reason string")
