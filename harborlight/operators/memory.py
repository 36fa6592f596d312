"""Memory of places where unexplained contacts recur, over passes in date order, with expiry by pass date."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS_NM, PASSES, MAX_AGE_DAYS = 0.08, 3, 180
_EARTH_NM = 3440.065


def distance_nm(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * _EARTH_NM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def fold(observations: pd.DataFrame, entries: list[dict] | None = None) -> list[dict]:
    """Entries (latitude, longitude, dates) after passes in ascending date order; a date counts once a place, undated rows teach nothing."""
    entries = [dict(e) for e in entries or []]
    seen = observations.dropna(subset=["date", "latitude", "longitude"])
    for day, rows in seen.sort_values(["date", "seq"], kind="stable").groupby("date", sort=True):
        entries = [e for e in entries if max(e["dates"]) >= day - timedelta(days=MAX_AGE_DAYS)]
        done: list[tuple[float, float]] = []
        for lat, lon in zip(rows.latitude, rows.longitude):
            if done and (distance_nm(lat, lon, *map(np.array, zip(*done))) <= RADIUS_NM).any():
                continue
            done.append((lat, lon))
            near = distance_nm(lat, lon, np.array([e["latitude"] for e in entries]), np.array([e["longitude"] for e in entries])) if entries else np.zeros(0)
            if not len(near) or near.min() > RADIUS_NM:
                entries.append({"latitude": round(lat, 6), "longitude": round(lon, 6), "dates": [day]})
                continue
            e = entries[int(near.argmin())]
            if day not in e["dates"]:
                e["latitude"], e["longitude"] = round((e["latitude"] + lat) / 2, 6), round((e["longitude"] + lon) / 2, 6)
                e["dates"] = sorted([*e["dates"], day])
    return entries


def remember(observations: DataFrame, region: str) -> DataFrame:
    """(region, latitude, longitude, passes, last, suppressed) from observations(region, seq, latitude, longitude, date).

    Each region folds alone, in one task; choose regions further apart than the radius, or their borders split places.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = [(g[region].iloc[0], e["latitude"], e["longitude"], len(e["dates"]), max(e["dates"]), len(e["dates"]) >= PASSES) for e in fold(g)]
        return pd.DataFrame(out, columns=[region, "latitude", "longitude", "passes", "last", "suppressed"])

    kind = dict(observations.dtypes)[region]
    return observations.groupBy(region).applyInPandas(run, f"{region} {kind}, latitude double, longitude double, passes int, last date, suppressed boolean")


def suppress(contacts: DataFrame, entries: DataFrame, protected: DataFrame, region: str, id_: str) -> DataFrame:
    """Contacts within the radius of a suppressed place, unless a predicted broadcaster is as near."""
    from harborlight.functions.geo import haversine_nm

    near = lambda other: haversine_nm(F.col("c.latitude"), F.col("c.longitude"), F.col(f"{other}.latitude"), F.col(f"{other}.longitude")) <= RADIUS_NM
    c = contacts.alias("c")
    hit = c.join(entries.where("suppressed").alias("e"), (F.col(f"c.{region}") == F.col(f"e.{region}")) & near("e"), "left_semi").alias("c")
    return hit.join(protected.alias("p"), (F.col(f"c.{region}") == F.col(f"p.{region}")) & near("p"), "left_anti")
