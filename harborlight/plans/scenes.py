"""Queries that run kernels over rendered scenes, one Arrow batch of scenes at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from harborlight.kernels import signals

from .dialect import duck_sql, frame

_BEARINGS = "select scene_id, scene_key, (scene_key * 29) % 360 as bearing from scenes"


def _searched(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(batches):
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    z, hull = signals.rendered(r.bearing, seed=r.scene_key, dark=kind == "lead")
                    got = signals.lead(z, 100, 100, 10.0) if kind == "lead" else signals.wake(z, hull, 100, 100, 10.0)
                    off = abs((got["bearing_deg"] - r.bearing + 180) % 360 - 180)
                    rows.append((r.scene_id, bool(got["found"]), bool(off <= 2), bool(abs(got["length_m"] - 600) <= 90)))
                yield pd.DataFrame(rows, columns=["scene_id", "found", "on_bearing", "of_length"])

        return frame(spark, sf_dir, _BEARINGS).mapInPandas(run, "scene_id string, found boolean, on_bearing boolean, of_length boolean")

    return query


QUERIES = {"k8_wake_rays": _searched("wake"), "k9_lead_rays": _searched("lead")}
#: Each rendered scene has one wake (or lead) of 600 m on a known bearing.
ORACLE = dict.fromkeys(QUERIES, duck_sql(lambda q: "select scene_id, true as found, true as on_bearing, true as of_length from scenes"))
