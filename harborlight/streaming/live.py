"""Streams: latest verdicts, stage changes, queue order, memory of passes, idempotent dispatch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators.memory import PASSES, fold

#: Priority files sent before one of the other queue.
PER_STANDARD = 3


def latest_verdicts(log: DataFrame) -> DataFrame:
    """(id, verdict, ts) of an append-only log(ts, labeller, id, verdict), newest wins; run it in update or complete mode."""
    clean = log.where(~F.col("id").startswith("__") & ~F.col("labeller").startswith("__") & (F.trim("id") != "") & (F.trim("verdict") != ""))
    return clean.groupBy("id").agg(F.max(F.struct("ts", "verdict")).alias("m")).select("id", "m.verdict", "m.ts")


def density(fixes: DataFrame, delay: str = "3 hours", span: str = "1 hour") -> DataFrame:
    """Broadcasts a window of fix time and scene; fixes older than the delay are late."""
    return fixes.withWatermark("fix_time", delay).groupBy(F.window("fix_time", span), "scene_id").agg(F.count("*").alias("n"), F.approx_count_distinct("mmsi").alias("vessels"))


def current_fixes(fixes: DataFrame, scenes: DataFrame, hours: int = 3) -> DataFrame:
    """Stream-stream join of fixes(mmsi, scene_id, fix_time, ...) to scenes(scene_id, shutter_time, ...) at most `hours` apart; both
    watermarks let state older than that go."""
    f, s = fixes.withWatermark("fix_time", f"{hours} hours").alias("f"), scenes.withWatermark("shutter_time", f"{hours} hours").alias("s")
    apart = F.expr(f"f.fix_time BETWEEN s.shutter_time - INTERVAL {hours} HOURS AND s.shutter_time + INTERVAL {hours} HOURS")
    return f.join(s, (F.col("f.scene_id") == F.col("s.scene_id")) & apart).select("f.*", "s.shutter_time")


def stage_changes(listings: DataFrame) -> DataFrame:
    """(filename, ts, from_stage, stage) whenever a file of listings(ts, filename, stage) is first seen or has moved; state is a stage a file."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if r.stage != before:
                out.append((key[0], r.ts, before, r.stage))
                before = r.stage
        state.update((before,))
        yield pd.DataFrame(out, columns=["filename", "ts", "from_stage", "stage"])

    return listings.groupBy("filename").applyInPandasWithState(run, "filename string, ts timestamp, from_stage string, stage string", "stage string", "append", "NoTimeout")


def remembered(seen: DataFrame, region: str) -> DataFrame:
    """The memory of places as a stream over observations(region, seq, latitude, longitude, date): a region's entries after each batch.

    State is the region's entries, pruned by the dates of its passes as the batch fold does, so no watermark drops a late pass. Rows
    of a batch fold in order of date; a pass that comes in several batches counts once, as a date does.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entries = [e | {"dates": [date.fromisoformat(d) for d in e["dates"]]} for e in json.loads(state.get[0])] if state.exists else []
        entries = fold(pd.concat(list(batches)), entries)
        state.update((json.dumps([e | {"dates": [d.isoformat() for d in e["dates"]]} for e in entries]),))
        rows = [(key[0], e["latitude"], e["longitude"], len(e["dates"]), max(e["dates"]), len(e["dates"]) >= PASSES) for e in entries]
        yield pd.DataFrame(rows, columns=[region, "latitude", "longitude", "passes", "last", "suppressed"])

    kind = dict(seen.dtypes)[region]
    return seen.groupBy(region).applyInPandasWithState(run, f"{region} {kind}, latitude double, longitude double, passes int, last date, suppressed boolean", "entries string", "update", "NoTimeout")


def send_order(files: DataFrame) -> DataFrame:
    """files(queue, name, bytes) with `sent`, their place: three of the priority queue, then one other, each queue by name."""
    from pyspark.sql import Window

    kind = F.when(F.col("queue") == "priority", 0).otherwise(1)
    i = F.row_number().over(Window.partitionBy("queue").orderBy("name")) - 1
    placed = files.withColumn("kind", kind).withColumn("i", i).withColumn("slot", F.when(F.col("kind") == 0, F.floor(F.col("i") / PER_STANDARD)).otherwise(F.col("i")))
    return placed.withColumn("sent", F.row_number().over(Window.orderBy("slot", "kind", "i"))).drop("kind", "i", "slot")


def poll(spark: SparkSession, folder: str, each: int = 64) -> DataFrame:
    """A queue folder as a stream of (name, path, bytes), at most `each` files a trigger; partial files (.part) are not seen."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,bin,enc}").option("recursiveFileLookup", True).option("maxFilesPerTrigger", each)
    return files.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -2).alias("queue"))


def dispatch_to(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: alerts whose source_filename no other batch has sent, into the batch's own folder.

    A batch that runs twice writes its folder anew with the same rows, so neither a crash nor a second driver sends twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["source_filename"])
        try:
            sent = batch.sparkSession.read.parquet(path).where(F.col("batch") != number).select("source_filename")
            new = new.join(sent, "source_filename", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
