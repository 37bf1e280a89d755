"""Points near points, and points in polygons, by cells and equi-joins.

Near: points become cells of a cube grid around the unit sphere, so that neither
the poles nor the antimeridian are special. Each point is sent to the few cells
that its search box touches and meets the owners of these cells; a hot cell is
salted. Within: each ring is covered by cells of one world-wide quadtree, as coarse
as possible inside, and along its border as fine as a number of cells allows, so
that a small region gets small cells. Interior cells accept by equi-join alone. A
border cell knows whether its corner lies inside, and carries the few edges that
touch it: a point in it is tested by the edges between it and that corner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.util import broadcast_if_small, cut, ship

#: Mean radius of the Earth in km, as the great-circle distance uses it.
RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def located(df: DataFrame, key: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Distinct id, lat, lng of the rows that have a location: not null, not NaN, in range, not (0, 0)."""
    la, ln = F.col(lat).cast("double"), F.col(lng).cast("double")
    ok = F.col(key).isNotNull() & la.between(-90.0, 90.0) & ln.between(-180.0, 180.0) & ~((la == 0) & (ln == 0))
    return df.filter(ok).select(F.col(key).alias("id"), la.alias("lat"), ln.alias("lng")).distinct()


def near(df: DataFrame, key: str, km: float, lat: str = "lat", lng: str = "lng", hot: int = 2_000) -> DataFrame:
    """id_a, id_b, km: each pair of ids with locations at most ``km`` apart, smaller id first, once, with the least distance.

    Rows without a location take no part. Cells with more than ``hot`` points are salted.
    """
    if not 0 < km < 1000:
        raise ValueError("km must lie between 0 and 1000")
    reach = 2 * math.sin(km / 2 / RADIUS_KM) * (1 + 1e-9) + 1e-12  # as a chord of the unit sphere
    side = 6 * reach  # of such cells a search box touches few
    p = cut(located(df, key, lat, lng))
    x, y, z = F.cos(F.radians("lat")) * F.cos(F.radians("lng")), F.cos(F.radians("lat")) * F.sin(F.radians("lng")), F.sin(F.radians("lat"))
    p = p.withColumns({"x": x, "y": y, "z": z})
    axes = ("x", "y", "z")
    cell = lambda shift: [F.floor((F.col(a) + shift) / side) for a in axes]
    own = p.select("id", "lat", "lng", F.struct(*[c.alias(a) for a, c in zip(axes, cell(0), strict=True)]).alias("cell"))
    box = p.select("id", "lat", "lng", *[F.sequence(lo, hi).alias(f"s{a}") for a, lo, hi in zip(axes, cell(-reach), cell(reach), strict=True)])
    for a in axes:
        box = box.withColumn(a, F.explode(f"s{a}"))
    box = box.select("id", "lat", "lng", F.struct(*[F.col(a) for a in axes]).alias("cell"))
    crowded = cut(own.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("cell", F.ceil(F.col("n") / hot).cast("int").alias("salts")))
    if not crowded.isEmpty():
        crowded = broadcast_if_small(crowded)
        own = own.join(crowded, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id", "lat", "lng"), F.coalesce("salts", F.lit(1))).cast("int"))
        box = box.join(crowded, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        on = ["cell", "salt"]
    else:
        on = ["cell"]
    a = own.select(*on, F.col("id").alias("id_a"), F.col("lat").alias("la"), F.col("lng").alias("na"))
    b = box.select(*on, F.col("id").alias("id_b"), F.col("lat").alias("lb"), F.col("lng").alias("nb"))
    pairs = a.join(b, on).filter(F.col("id_a") < F.col("id_b")).withColumn("km", haversine_km(F.col("la"), F.col("na"), F.col("lb"), F.col("nb")))
    return pairs.filter(F.col("km") <= km).groupBy("id_a", "id_b").agg(F.min("km").alias("km"))


#: Cells along a ring's border from which it isn't refined further, and the finest level (about 2 m).
BORDER_CELLS, FINEST = 128, 24
#: Cells overlap by this many degrees, so that no point falls between them and corners keep off round coordinates.
_PAD = 1.2345e-9


def _touching(e: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which segments (x1, y1, x2, y2) touch a closed rectangle, by clipping at its sides."""
    x1, y1, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    lo, hi, ok = np.zeros(len(e)), np.ones(len(e)), np.ones(len(e), dtype=bool)
    for p, q in ((-dx, x1 - box[0]), (dx, box[2] - x1), (-dy, y1 - box[1]), (dy, box[3] - y1)):
        flat = p == 0
        ok &= ~flat | (q >= 0)
        t = q / np.where(flat, 1.0, p)
        lo = np.where(p < 0, np.maximum(lo, t), lo)
        hi = np.where(p > 0, np.minimum(hi, t), hi)
    return ok & (lo <= hi)


def _flips(e: np.ndarray, x: float, y: float, cx: float, cy: float) -> bool:
    """Whether a point and a corner to its north-east lie on different sides of the ring: the edges met going east to the corner's longitude, then north."""
    x1, y1, x2, y2 = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        east = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        north = (y2 - y1) * (cx - x1) / (x2 - x1) + y1
    met = np.count_nonzero(((y1 > y) != (y2 > y)) & (x < east) & (east < cx)) + np.count_nonzero(((x1 > cx) != (x2 > cx)) & (north > y) & (north < cy))
    return met % 2 == 1


def _ring_cells(edges: np.ndarray, border_cells: int, finest: int) -> Iterator[tuple]:
    """level, i, j, inner, corner inside, edges of the cells of one ring."""
    level, border = 0, [(0, 0, False, edges)]  # the world's corner is outside
    while border:
        if level == finest or 2 * len(border) > border_cells:
            yield from ((level, i, j, False, inside, e.tolist()) for i, j, inside, e in border)
            return
        level += 1
        w, h = 360.0 / 2**level, 180.0 / 2**level
        deeper = []
        for i0, j0, corner, e in border:
            cx0, cy0 = -180 + (i0 + 1) * 2 * w + _PAD, -90 + (j0 + 1) * 2 * h + _PAD
            for i, j in ((2 * i0 + a, 2 * j0 + b) for a in (0, 1) for b in (0, 1)):
                cx, cy = -180 + (i + 1) * w + _PAD, -90 + (j + 1) * h + _PAD
                inside = corner != _flips(e, cx, cy, cx0, cy0)
                near = e[_touching(e, (cx - w - 3 * _PAD, cy - h - 3 * _PAD, cx + _PAD, cy + _PAD))]
                if len(near):
                    deeper.append((i, j, inside, near))
                elif inside:
                    yield level, i, j, True, True, []
        border = deeper


def _cover(batches: Iterator[pd.DataFrame], border_cells: int, finest: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for region, ring in zip(batch["region"], batch["ring"], strict=True):
            pts = [(float(q["lng"]), float(q["lat"])) for q in ([] if ring is None else ring) if q is not None and q["lng"] is not None and q["lat"] is not None]
            edges = np.array([(*p, *q) for p, q in zip(pts, [*pts[1:], *pts[:1]], strict=True) if p != q])
            if len(pts) < 3 or not len(edges):
                continue
            out = [(region, *c) for c in _ring_cells(edges, border_cells, finest)]
            if out:
                yield pd.DataFrame(out, columns=["region", "level", "i", "j", "inner", "corner", "edges"])


def coverage(regions: DataFrame, key: str, ring: str, border_cells: int = BORDER_CELLS, finest: int = FINEST) -> DataFrame:
    """region, level, i, j, inner, corner, edges: the cells of each ring (array of structs with lng and lat, closed or not).

    A ring is refined, level by level, while that leaves at most about ``border_cells`` cells along its border.
    """
    ship(regions.sparkSession)
    rings = regions.select(F.col(key).alias("region"), F.col(ring).alias("ring")).filter("region is not null and ring is not null")
    return rings.mapInPandas(lambda it: _cover(it, border_cells, finest), f"region {dict(rings.dtypes)['region']}, level int, i int, j int, inner boolean, corner boolean, edges array<array<double>>")


def within(df: DataFrame, key: str, regions: DataFrame, region_key: str, ring: str, lat: str = "lat", lng: str = "lng", border_cells: int = BORDER_CELLS, finest: int = FINEST) -> DataFrame:
    """id, region: each id with a location in any ring of a region, once. Edges are straight in lng/lat.

    Rings with fewer than three points cover nothing; a point exactly on an edge
    belongs to the side that a ray to the east decides.
    """
    cells = cut(coverage(regions, region_key, ring, border_cells, finest))
    levels = [r[0] for r in cells.select("level").distinct().orderBy("level").collect()]  # at most finest + 1
    p = located(df, key, lat, lng).withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    n = F.pow(F.lit(2.0), F.col("level"))
    at = lambda c, low, span: F.least(F.floor((F.col(c) - low) / span * n), n - 1).cast("int")
    hits = p.withColumns({"i": at("lng", -180, 360), "j": at("lat", -90, 180)}).join(broadcast_if_small(cells), ["level", "i", "j"])
    corner = lambda c, low, span: low + (F.col(c) + 1) * (span / n) + _PAD
    hits = hits.withColumns({"cx": corner("i", -180, 360), "cy": corner("j", -90, 180)})

    def met(e: Column) -> Column:
        x1, y1, x2, y2 = (F.get(e, F.lit(k)) for k in range(4))
        x, y = F.col("lng"), F.col("lat")
        east = F.when((y1 > y) != (y2 > y), (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        north = F.when((x1 > F.col("cx")) != (x2 > F.col("cx")), (y2 - y1) * (F.col("cx") - x1) / (x2 - x1) + y1)
        return F.when((x < east) & (east < F.col("cx")), 1).otherwise(0) + F.when((north > y) & (north < F.col("cy")), 1).otherwise(0)

    odd = F.aggregate("edges", F.col("corner").cast("int"), lambda acc, e: acc + met(e)) % 2 == 1
    return hits.filter(F.col("inner") | odd).select("id", "region").distinct()
