"""Band joins and nearest neighbours over points, by cells instead of all pairs."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions.geo import haversine_nm

from .lineage import cut

#: Points of a tile at most, and how far apart two chords (of a unit sphere) may be that rounding could have put in the wrong order.
TILE, SLACK = 500, 1e-12


def cell_join(left: DataFrame, right: DataFrame, radius_nm: float) -> DataFrame:
    """Pairs of rows (columns l and r, structs) of points at most radius_nm apart, with `nm`; both sides have latitude and longitude.

    Rows of cells are as high as the radius, and each has as many columns as keep a cell as wide as the radius reaches in longitude
    there, one at the poles. The right side goes to every cell it reaches in its own row and the two beside it, so the join has an
    equality key and misses no pair anywhere on the sphere.
    """
    high = radius_nm / 60.0 * 1.001
    # how far the radius reaches in longitude from the row of cells, and the columns of that row
    edge = lambda row: F.greatest(F.abs(row), F.abs(row + 1)) * high + high
    reach = lambda row: F.when(edge(row) + high >= 90, 180.0).otherwise(F.degrees(F.asin(math.sin(math.radians(high)) / F.cos(F.radians(F.least(edge(row), F.lit(89.999))))))) * 1.001
    columns = lambda row: F.greatest(F.floor(360.0 / reach(row)), F.lit(1)).cast("long")
    at = lambda lon, row: F.floor((lon + 180.0) * columns(row) / 360.0)
    cell = F.floor(F.col("latitude") / high)
    a = left.select(F.struct(*left.columns).alias("l"), cell.alias("cy"), F.pmod(at(F.col("longitude"), cell), columns(cell)).alias("cx"))
    b = right.select(F.struct(*right.columns).alias("r"), "longitude", F.explode(F.sequence(cell - 1, cell + 1)).alias("cy"))
    around = F.sequence(at(F.col("longitude") - reach(F.col("cy")), F.col("cy")), at(F.col("longitude") + reach(F.col("cy")), F.col("cy")))
    b = b.select("r", "cy", F.explode(F.array_distinct(F.transform(around, lambda x: F.pmod(x, columns(F.col("cy")))))).alias("cx"))
    nm = haversine_nm(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return a.join(b, ["cy", "cx"]).select("l", "r", nm.alias("nm")).where(F.col("nm") <= radius_nm)


def _place(latitude: Column, longitude: Column) -> Column:
    """Where a point is on the curve that interleaves the bits of latitude and longitude: points near on it lie near each other."""

    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    unit = lambda x, span: F.floor(F.pmod(x + span / 2, F.lit(span)) / span * ((1 << 31) - 1)).cast("long")
    return F.shiftleft(spread(unit(latitude, 360.0)), 1).bitwiseOR(spread(unit(longitude, 360.0)))


def _on_sphere(latitude: np.ndarray, longitude: np.ndarray) -> np.ndarray:
    """Points as unit vectors, as columns; chords between them order as great-circle distances do."""
    a, b = np.radians(latitude), np.radians(longitude)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((x[:, None] - y[None, :]) ** 2 for x, y in zip(a, b)))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(group, rows): a batch in order of groups cut where the group changes and after each TILE rows."""
    groups, start = b.column("group").to_pylist(), 0
    for i in range(1, len(groups) + 1):
        if i == len(groups) or groups[i] != groups[start] or i - start == TILE:
            yield groups[start], b.slice(start, i - start)
            start = i


def _floats(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """group, key, id: for each row of left(group, key long, latitude, longitude) the nearest of right(group, id, latitude, longitude) in its group.

    Ties go to the smaller id; a row without a position takes the smallest id of its group, one whose group has no right row goes. Pairs
    (group, key) must be unique, and right rows have positions. No pairs of all rows are made: rows of right at one position are one
    point, points near each other make a tile of up to TILE, and a left row meets the tiles alone that can hold its nearest point by
    their bounding spheres, a number that depends on the shape of the data and not on its size. The driver and each task hold the bounding
    spheres, five numbers for each TILE points. Chords only leave candidates; the haversine decides between these.
    """
    spark = left.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * TILE))
    placed = lambda d: d.withColumn("place", _place(F.col("latitude"), F.col("longitude"))).repartitionByRange("group", "place").sortWithinPartitions("group", "place")
    points = right.where("group is not null").groupBy("group", "latitude", "longitude").agg(F.min("id").alias("id"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = defaultdict(list)
            for group, part in _runs(b):
                lat, lon = _floats(part.column("latitude")), _floats(part.column("longitude"))
                at = _on_sphere(lat, lon)
                centre = at.mean(axis=1)
                for name, v in (("group", group), ("centre", centre.tolist()), ("radius", float(_chords(at, centre[:, None]).max())), ("lats", lat), ("lons", lon), ("ids", part.column("id").to_pylist())):
                    rows[name].append(v)
            if rows:
                yield pa.RecordBatch.from_pydict({"group": pa.array(rows["group"], pa.string()), "centre": pa.array(rows["centre"], pa.list_(pa.float64())), "radius": pa.array(rows["radius"], pa.float64()), "lats": pa.array(rows["lats"], pa.list_(pa.float64())), "lons": pa.array(rows["lons"], pa.list_(pa.float64())), "ids": pa.array(rows["ids"], pa.list_(pa.string()))})

    made = placed(points).mapInArrow(tiles, "group string, centre array<double>, radius double, lats array<double>, lons array<double>, ids array<string>")
    made = cut(made.withColumn("tile", F.monotonically_increasing_id()))
    spheres: dict[str, list] = defaultdict(list)
    for r in made.select("group", "tile", "centre", "radius").toLocalIterator():
        spheres[r.group].append((r.tile, *r.centre, r.radius))
    known = spark.sparkContext.broadcast({g: np.array([x[0] for x in v], np.int64) for g, v in spheres.items()}), spark.sparkContext.broadcast({g: np.array([x[1:] for x in v]).T for g, v in spheres.items()})

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bounds = known[0].value, known[1].value
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for group, part in _runs(b):
                if group not in bounds:
                    continue
                lat, lon, key = (_floats(part.column(c)) for c in ("latitude", "longitude", "key"))
                away = _chords(_on_sphere(lat, lon), bounds[group][:3])
                meets = away - bounds[group][3] <= (away + bounds[group][3]).min(axis=1)[:, None] + SLACK
                for t in np.flatnonzero(meets.any(axis=0)):
                    some = meets[:, t]
                    for x, v in zip(out, (group, numbers[group][t], key[some], lat[some], lon[some])):
                        x.append(v)
            yield pa.RecordBatch.from_pydict({"group": pa.array(out[0], pa.string()), "tile": pa.array(out[1], pa.int64()), "keys": pa.array(out[2], pa.list_(pa.int64())), "lat": pa.array(out[3], pa.list_(pa.float64())), "lon": pa.array(out[4], pa.list_(pa.float64()))})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                keys, lat, lon, lats, lons, ids = (b.column(c)[i].values for c in ("keys", "lat", "lon", "lats", "lons", "ids"))
                away = _chords(_on_sphere(_floats(lat), _floats(lon)), _on_sphere(_floats(lats), _floats(lons)))
                l, r = (pa.array(x) for x in np.nonzero(away <= away.min(axis=1)[:, None] + SLACK))
                yield pa.RecordBatch.from_pydict({"group": pa.array([b.column("group")[i].as_py()] * len(l), pa.string()), "key": keys.take(l), "lat": lat.take(l), "lon": lon.take(l), "lats": lats.take(r), "lons": lons.take(r), "id": ids.take(r)})

    finite = F.coalesce(F.abs("latitude") + F.abs("longitude") < float("inf"), F.lit(False))
    met = placed(left.where(finite)).mapInArrow(lots, "group string, tile long, keys array<long>, lat array<double>, lon array<double>").join(made.select("tile", "lats", "lons", "ids"), "tile")
    close = met.mapInArrow(candidates, "group string, key long, lat double, lon double, lats double, lons double, id string")
    best = close.groupBy("group", "key").agg(F.min(F.struct(haversine_nm(F.col("lats"), F.col("lons"), F.col("lat"), F.col("lon")).alias("nm"), "id")).alias("best"))
    first = points.groupBy("group").agg(F.min("id").alias("id"))
    return best.select("group", "key", "best.id").union(left.where(~finite).join(first, "group").select("group", "key", "id"))
