"""python -m harborlight run -i BUNDLE -o FOLDER [-c CONFIG] [-t TRACK] [--no-verifier] [--arctic]; ends with 0, or 2 for a bad bundle."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="harborlight")
    run = parser.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("-i", "--input", required=True)
    run.add_argument("-o", "--output", required=True)
    run.add_argument("-c", "--config")
    run.add_argument("-t", "--track")
    run.add_argument("--no-verifier", action="store_true")
    run.add_argument("--arctic", action="store_true")
    given = parser.parse_args(arguments)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from harborlight.plans import stages
    from harborlight.sources import sinks
    from harborlight.sources.bundle import InvalidManifestError

    config = stages.Config.load(given.config)
    config = replace(config, track=given.track or config.track, verifier=config.verifier and not given.no_verifier, arctic=config.arctic or given.arctic)
    spark, start = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), time.time()
    try:
        frames = stages.run_pass(spark, given.input, config)
    except (InvalidManifestError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    scenes, rejected = frames["scenes"].drop("contacts"), frames["rejected"]
    targets = frames.get("targets")
    if targets is None:
        targets = scenes.limit(0).select(F.lit("").alias("detection_id"), F.lit(0.0).alias("priority"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    elif "latitude" not in targets.columns:
        targets = targets.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    nobody = spark.createDataFrame([], "mmsi string, latitude double, longitude double, reason string")
    manifest = sinks.package(given.output, targets, nobody, scenes, rejected, budget=config.budget_bytes)
    sinks.write_telemetry(f"{given.output}/telemetry.json", {"wall_s": round(time.time() - start, 3), "contacts": manifest["contacts"]})
    print(stages.table_text([(n, f["bytes"]) for n, f in manifest["files"].items()], ("file", "bytes")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
