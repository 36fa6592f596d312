"""A pass as named stages over tables; a track is a list of stages by name."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.sources import bundle

#: The tables that a pass has so far, by name; a stage returns a new dict and changes none.
Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Config:
    """What a pass may be told; defaults are the engine's."""

    track: str = "full"
    gsd_meters: float = 10.0
    max_cloud_pct: float = 60.0
    min_valid_pct: float = 75.0
    min_water_pct: float = 5.0
    verifier: bool = True
    model_path: str | None = None
    arctic: bool = False
    memory_path: str | None = None
    budget_bytes: int = 512_000
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None) -> "Config":
        """From a YAML or JSON file; a missing or empty one gives the defaults, unknown keys are kept in `extra`."""
        import json
        import os

        if not path or not os.path.isfile(path):
            return cls()
        with open(path) as f:
            text = f.read()
        try:
            import yaml

            given = yaml.safe_load(text) or {}
        except ImportError:
            given = json.loads(text) if text.strip() else {}
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return replace(cls(**known), extra={k: v for k, v in given.items() if k not in known})


class Stage(Protocol):
    """One step of a pass."""

    def transform(self, frames: Frames, config: Config) -> Frames: ...


class Screen:
    """scenes, rejected: which scenes can be searched, and why others can't."""

    def transform(self, frames: Frames, config: Config) -> Frames:
        s = frames["detected"]
        reason = F.array_compact(F.array(F.when(F.col("valid_pct") < config.min_valid_pct, "LOW_VALID_DATA"), F.when(F.col("cloud_pct") > config.max_cloud_pct, "CLOUD")))
        reason = F.when((F.size(reason) == 0) & (F.col("water_pct") < config.min_water_pct), F.array(F.lit("NO_OPEN_WATER"))).otherwise(reason)
        s = s.withColumn("reasons", F.when(F.col("error").isNull(), reason).otherwise(F.array("error")))
        return frames | {"scenes": s.where(F.size("reasons") == 0), "rejected": s.where(F.size("reasons") > 0).drop("contacts")}


class Detect:
    """contacts: one row a contact of a usable scene, numbered by row and column."""

    def transform(self, frames: Frames, config: Config) -> Frames:
        from pyspark.sql import Window

        c = frames["scenes"].select("scene_id", F.explode("contacts").alias("c")).select("scene_id", "c.*")
        k = F.row_number().over(Window.partitionBy("scene_id").orderBy("y", "x"))
        return frames | {"contacts": c.withColumn("detection_id", F.concat("scene_id", F.lit("_T"), F.lpad(k.cast("string"), 3, "0")))}


class Rank:
    """targets: contacts with class and priority; without broadcasts in the bundle each is dark."""

    def transform(self, frames: Frames, config: Config) -> Frames:
        score = F.least(F.lit(1.0), F.col("peak_z") / 20)
        return frames | {"targets": frames["contacts"].withColumns({"classification": F.lit("DARK_VESSEL"), "confidence": F.round(score, 3), "priority": F.round(0.70 + 0.30 * F.round(score, 3), 3)})}


#: Stages of each track, in order; "quality" ends after screening, and has two older names.
TRACKS: dict[str, list[type]] = {"full": [Screen, Detect, Rank]} | dict.fromkeys(("quality", "screening", "track4"), [Screen])


def build(track: str) -> list[Stage]:
    if track not in TRACKS:
        raise ValueError(f"track {track!r} is none of {sorted(TRACKS)}")
    return [s() for s in TRACKS[track]]


def run_pass(spark: SparkSession, path: str, config: Config = Config()) -> Frames:
    """All stages of the track over a bundle. Rasters are read once, in `detected`, and no table holds pixels."""
    frames: Frames = {"detected": bundle.detect(spark, path)}
    for stage in build(config.track):
        frames = stage.transform(frames, config)
    return frames


def table_text(rows: list[tuple], header: tuple) -> str:
    """Rows as aligned text."""
    cells = [tuple("" if v is None else str(v) for v in r) for r in (header, *rows)]
    width = [max(map(len, c)) for c in zip(*cells)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:]])
