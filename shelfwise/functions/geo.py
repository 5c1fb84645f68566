"""Great-circle distance and exact nearest-neighbour search that prunes by map cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Cell edges in degrees, coarse to fine. A region holds a bounded number of cells, whatever
# the number of stores, so each probe meets few cells before it meets any point. The finest, of
# about 3 km, holds for towns; for regions wider than a country put a coarser size in front.
CELL_DEGREES = (2.0, 0.25, 0.03)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lng), 2
    )
    return F.lit(EARTH_RADIUS_KM * 2) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def _cell(col: str, size: float) -> Column:
    return F.floor(F.col(col) / F.lit(size)).cast("int")


def nearest_points(
    probes: DataFrame,
    points: DataFrame,
    on: list[str],
    probe_key: list[str],
    point_key: str,
    k: int = 1,
    cell_degrees: tuple[float, ...] = CELL_DEGREES,
) -> DataFrame:
    """The k nearest points of every probe among the points that share its ``on`` columns.

    ``probes`` carry ``on``, ``probe_key``, lat, lng (one row per probe_key); ``points`` carry
    ``on``, ``point_key``, lat, lng. Result: probe_key, the point's columns, distance_km and
    ``nth`` (1 = nearest, ties by point_key). Probes without any point do not appear. Points whose
    ``on`` values no probe asks for are dropped first.

    Exact. Points are first counted per cell. With the cell centre c and radius r, every point
    of the cell lies within d(probe, c) +- r. Cells, in order of that upper bound, are summed up
    to k points; a cell whose lower bound lies beyond the upper bound reached cannot hold a
    result and is dropped. The test is repeated on finer cells, and only the points of the
    surviving cells are joined, so a group never yields all its pairs.
    """
    levels = [(f"_y{i}", f"_x{i}", size) for i, size in enumerate(cell_degrees)]
    gridded = points.join(probes.select(*on).distinct(), on, "left_semi")
    for y, x, size in levels:
        gridded = gridded.withColumn(y, _cell("lat", size)).withColumn(x, _cell("lng", size))

    probe_cols = list(dict.fromkeys([*on, *probe_key]))
    live = probes.select(*probe_cols, F.col("lat").alias("_plat"), F.col("lng").alias("_plng"))
    here = live
    by_probe = Window.partitionBy(*probe_key)
    reach = by_probe.orderBy("_hi").rangeBetween(Window.unboundedPreceding, 0)
    path: list[str] = []
    for y, x, size in levels:
        known = [*on, *path]
        path += [y, x]
        cells = gridded.groupBy(*on, *path).agg(F.count(F.lit(1)).alias("_n"))
        radius = EARTH_RADIUS_KM * math.radians(size) * math.sqrt(0.5)
        centre = haversine_km(
            F.col("_plat"), F.col("_plng"), (F.col(y) + 0.5) * F.lit(size), (F.col(x) + 0.5) * F.lit(size)
        )
        here = (
            here.join(cells, known)
            .withColumn("_mid", centre)
            .withColumn("_hi", F.col("_mid") + F.lit(radius))
            .withColumn("_seen", F.sum("_n").over(reach))
            .withColumn("_limit", F.min(F.when(F.col("_seen") >= k, F.col("_hi"))).over(by_probe))
            .where(F.col("_limit").isNull() | (F.col("_mid") - F.lit(radius) <= F.col("_limit") + 1e-6))
            .select(*probe_cols, "_plat", "_plng", *path)
        )

    ranked = by_probe.orderBy("distance_km", point_key)
    found = here.join(gridded, [*on, *path]).withColumn(
        "distance_km", haversine_km(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng"))
    )
    return (
        found.withColumn("nth", F.row_number().over(ranked))
        .where(F.col("nth") <= k)
        .drop("_plat", "_plng", *path)
    )
