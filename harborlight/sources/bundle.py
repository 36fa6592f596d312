"""A scene bundle as tables: manifest, scenes and rasters with per-scene quarantine, and the broadcast catalogue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.kernels import raster

SCENE = "id string, file string, shutter_time string, gsd_meters double, center_lat double, center_lon double, reflectance_scale double, reflectance_offset double, bands array<string>"
VESSEL = "mmsi string, name string, timestamp string, latitude double, longitude double, sog_knots double, cog_deg double, heading_deg double, length_m double, vessel_type string, transceiver_class string, delta_hours_to_shutter double"


class InvalidManifestError(ValueError):
    """The bundle is no folder, or its manifest no JSON object."""


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, content) under the bundle, by the path relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").removeprefix("file:").replace("//", "/") + "/"
    return files.select(F.regexp_replace(F.expr(f"substring(path, instr(path, {root!r}) + {len(root)})"), "%20", " ").alias("file"), "content")


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene of manifest.json; a scene's own fields win over the manifest's. Ground truth is not read.

    Without a manifest every raster of the folder is a scene, named after its file.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise InvalidManifestError(f"no folder: {path}")
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(root, "manifest.json")):
        named = _files(spark, path, "*.{npy,tif,tiff,png,jpg,jpeg}").select("file").where("instr(file, '/') = 0")
        empty = dict.fromkeys(("center_lat", "center_lon", "gsd_meters", "reflectance_scale", "reflectance_offset"), "double")
        return named.select(F.regexp_replace("file", "[.][^.]*$", "").alias("scene_id"), "file", *[F.lit(None).cast(t).alias(n) for n, t in (("center_lat", "double"), ("center_lon", "double"), ("shutter_time", "string"), *[(k, v) for k, v in empty.items() if k.startswith(("gsd", "refl"))], ("bands", "array<string>"))])
    whole = spark.read.text(f"{path}/manifest.json", wholetext=True).first()
    if whole is None or not isinstance(_parsed(whole.value), dict):
        raise InvalidManifestError("manifest.json holds no JSON object")
    m = spark.read.schema(f"gsd_meters double, reflectance_scale double, reflectance_offset double, bands array<string>, shutter_time string, scenes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SCENE.split(', '))}>>").option("multiLine", True).json(f"{path}/manifest.json")
    s = m.select("*", F.explode("scenes").alias("s"))
    own = {c: F.coalesce(F.col(f"s.{c}"), F.col(c)) for c in ("shutter_time", "gsd_meters", "reflectance_scale", "reflectance_offset", "bands")}
    safe = ~F.col("s.file").rlike(r"(^|/)\.\.(/|$)|^/")
    return s.select(F.col("s.id").alias("scene_id"), F.when(safe, F.col("s.file")).alias("file"), "s.center_lat", "s.center_lon", *[c.alias(n) for n, c in own.items()])


def _parsed(text: str):
    import json

    try:
        return json.loads(text)
    except ValueError:
        return None


def structures(spark: SparkSession, path: str) -> DataFrame:
    """Rows of known_structures.json with a position, in the file's order; radius 150 m where none is given. Broken files give none."""
    d = spark.read.schema("structures array<struct<name: string, latitude: double, longitude: double, radius_m: double>>").option("multiLine", True).json(f"{path}/known_structures.json")
    d = d.select(F.posexplode("structures").alias("pos", "s")).select("pos", "s.name", "s.latitude", "s.longitude", F.coalesce("s.radius_m", F.lit(150.0)).alias("radius_m"))
    return d.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def bundles(root: str) -> list[str]:
    """Folders below root with a manifest, outputs left out."""
    import os

    return sorted(d for d, _, files in os.walk(root) if "manifest.json" in files and "output" not in os.path.basename(d).lower())


def vessels(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ais_catalog.json with a position; unparseable files give none."""
    v = spark.read.schema(f"vessels array<struct<{', '.join(x.replace(' ', ': ', 1) for x in VESSEL.split(', '))}>>").option("multiLine", True).json(f"{path}/ais_catalog.json")
    return v.select(F.posexplode("vessels").alias("pos", "v")).select("pos", "v.*").where("latitude IS NOT NULL AND longitude IS NOT NULL")


_OUT = "scene_id string, error string, width int, height int, cloud_pct double, ice_pct double, water_pct double, valid_pct double, contacts array<struct<y: double, x: double, area_px: int, length_m: double, width_m: double, heading_deg: double, peak_z: double>>"


def detect(spark: SparkSession, path: str) -> DataFrame:
    """Each scene screened and searched in one pass over its raster; one that can't be read has an error code instead."""
    s, files = scenes(spark, path), _files(spark, path, "*.{npy,tif,tiff,png,jpg,jpeg}")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                row: dict = dict.fromkeys(("error", "width", "height", "cloud_pct", "ice_pct", "water_pct", "valid_pct", "contacts"))
                try:
                    if r.content is None:
                        raise ValueError("FILE_NOT_FOUND")
                    refl, empty, _ = raster.reflectance(raster.decode(r.file, r.content), list(r.bands) if r.bands is not None else None, None if pd.isna(r.reflectance_scale) else r.reflectance_scale, 0.0 if pd.isna(r.reflectance_offset) else r.reflectance_offset)
                    gsd = 10.0 if pd.isna(r.gsd_meters) else float(r.gsd_meters)
                    m = raster.screen(refl, empty, gsd)
                    found = raster.contacts(refl, empty, gsd)
                    row |= {"height": refl.shape[0], "width": refl.shape[1], **{k: float(m[k]) for k in ("cloud_pct", "ice_pct", "water_pct", "valid_pct")}, "contacts": [{k: c[k] for k in ("y", "x", "area_px", "length_m", "width_m", "heading_deg", "peak_z")} for c in found]}
                except ValueError as e:
                    row["error"] = str(e) if str(e).split(":")[0] in ("FILE_NOT_FOUND", "ZERO_BYTE_FILE", "EMPTY_OR_TINY_RASTER", "NO_USABLE_BANDS", "DECODE_ERROR") else "DECODE_ERROR: ValueError"
                except Exception as e:  # noqa: BLE001  one bad scene must not end the pass
                    row["error"] = f"DECODE_ERROR: {type(e).__name__}"
                rows.append({"scene_id": r.scene_id} | row)
            yield pd.DataFrame(rows, columns=["scene_id", "error", "width", "height", "cloud_pct", "ice_pct", "water_pct", "valid_pct", "contacts"]).astype({"width": "Int32", "height": "Int32"})

    wide = s.join(files, "file", "left").select("scene_id", "file", "content", "bands", "gsd_meters", "reflectance_scale", "reflectance_offset")
    return wide.mapInPandas(run, _OUT)


def write_bundle(path: str, gsd: float = 10.0, seed: int = 3) -> None:
    """A small bundle for tests: a sea scene with bright hulls, a truncated file, a tiny raster."""
    import json
    import os

    os.makedirs(path, exist_ok=True)
    rng = np.random.default_rng(seed)
    sea = np.full((256, 256, 4), (0.03, 0.05, 0.05, 0.02)) + rng.normal(0, 0.002, (256, 256, 4))
    for y, x in ((60, 60), (150, 200), (220, 90)):
        sea[y : y + 4, x : x + 12] = 0.3
    np.save(f"{path}/sea.npy", sea.astype(np.float32))
    with open(f"{path}/bad.npy", "wb") as f:
        f.write(b"\x93NUMPY")
    np.save(f"{path}/tiny.npy", np.zeros((4, 4, 4), np.float32))
    names = ("sea", "bad", "tiny", "gone")
    with open(f"{path}/manifest.json", "w") as f:
        json.dump({"gsd_meters": gsd, "shutter_time": "2024-01-15T12:00:00Z", "scenes": [{"id": n.upper(), "file": f"{n}.npy", "center_lat": 44.6, "center_lon": -63.5} for n in names]}, f)
    with open(f"{path}/ais_catalog.json", "w") as f:
        json.dump({"vessels": [{"mmsi": 316000001, "name": "A", "latitude": 44.6, "longitude": -63.5}, {"mmsi": "2", "name": "no position"}]}, f)
