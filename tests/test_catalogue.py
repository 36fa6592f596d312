"""Catalogued queries against brute force that uses no SQL."""

import collections
import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from harborlight.operators import memory
from harborlight.plans import catalogue, registry
from harborlight.plans.dialect import Dialect, frame, spark_query

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize("profile, configured, cap", [("FULL", 400, 400), ("FULL", 500, 400), ("REDUCED", 400, 250), ("SURVEY", 400, 120), ("BEACON", 400, 60), ("FULL", 7, 7)])
def test_candidate_cap(spark, profile, configured, cap):
    scenes = collections.defaultdict(list)
    for r in frame(spark, DIR, "select scene_id, detection_id, hull_len_m, x, y from contacts").collect():
        scenes[r.scene_id].append((-r.hull_len_m, r.y, r.x, r.detection_id))
    want = {d for rows in scenes.values() for *_, d in sorted(rows)[:cap]}
    got = [r.detection_id for r in spark_query(catalogue.candidate_cap(profile, configured))(spark, DIR).collect()]
    assert len(got) == len(want) and set(got) == want
    if (profile, configured) == ("FULL", 400):
        assert {r.detection_id for r in registry.QUERIES["l1_candidate_cap"](spark, DIR).collect()} == want


@pytest.mark.parametrize("long_run", [0, 500])
def test_stage_changes(spark, tmp_path, long_run):
    rng, at = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=rng.randrange(400)), rng.randrange(9), rng.choice("abc")) for i in range(600)]
    rows += [(1000 + i, at + datetime.timedelta(days=1, seconds=i), 3, "z") for i in range(long_run)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    stage, changes = {}, []
    for i, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if stage.get(user) != kind:
            changes.append((user, i, stage.get(user), kind))
        stage[user] = kind
    got = [tuple(r) for r in registry.QUERIES["w10_stage_changes"](spark, str(tmp_path)).collect()]
    assert len(got) == 100 and sorted(got) == sorted(changes[-100:])


def _near(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= 0.08


def test_suppression_by_every_structure(spark):
    sf = DIR.replace("sf0.1", "sf0.01")
    contacts = frame(spark, sf, "select scene_id, detection_id, latitude, longitude from contacts")
    regions = frame(spark, sf, "select scene_id, pos, latitude, longitude, true as suppressed from structures")
    ships = frame(spark, sf, "select scene_id, plat as latitude, plon as longitude from catalog")
    held, safe = collections.defaultdict(list), collections.defaultdict(list)
    for r in regions.collect():
        held[r.scene_id].append((r.latitude, r.longitude))
    for r in ships.collect():
        safe[r.scene_id].append((r.latitude, r.longitude))
    want = sorted(r.detection_id for r in contacts.collect() if any(_near((r.latitude, r.longitude), s) for s in held[r.scene_id]) and not any(_near((r.latitude, r.longitude), s) for s in safe[r.scene_id]))
    assert sorted(r.detection_id for r in registry.QUERIES["j13_suppression"](spark, sf).collect()) == want
    assert sorted(r.detection_id for r in memory.suppress(contacts, regions, ships, "scene_id", "detection_id").collect()) == want
    assert memory.suppress(contacts, regions.withColumn("suppressed", F.lit(False)), ships, "scene_id", "detection_id").count() == 0


def test_scene_acceptance_leaves_no_event_out(spark, tmp_path):
    rows = [(i, i % 50, None if i % 11 == 0 else float(i * 37 % 90)) for i in range(1, 400)] + [(700, 3, 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    best = {}
    for i, user, v in rows:
        if v is not None and v <= 60:
            best[user % 25] = min(best.get(user % 25, (99.0, 0)), (v, i))
    assert best[3] == (0.0, 700)
    assert {(r.aoi, r.event_id) for r in registry.QUERIES["y16_scene_acceptance"](spark, str(tmp_path)).collect()} == {(a, i) for a, (_, i) in best.items()}


def test_fixed_digits_round_as_printf_does(spark):
    rng = random.Random(3)
    xs = [0.125, 0.375, 0.145, 0.005, -0.005, 2.675, 1.005, 0.0, -0.0, -0.001, 179.99995, -80.00005]
    xs += [k / 1000 for k in range(-2000, 2000)] + [k / 800 for k in range(-2000, 2000)] + [round(rng.uniform(-180, 180), 5) for _ in range(4000)]
    d = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", Dialect(True).fixed("x", 2) + " as two", Dialect(True).fixed("x", 4) + " as four")
    assert [(r.two, r.four) for r in d.collect() if (r.two, r.four) != (f"{r.x:.2f}", f"{r.x:.4f}")] == []


def test_notes_round_distances_as_their_sql_does(spark, tmp_path):
    for table, held in (("nation", "true"), ("customer", "c_custkey = 149"), ("events", "user_id = 549"), ("supplier", "s_suppkey < 0")):
        spark.read.parquet(f"{DIR}/{table}.parquet").where(held).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    for table in ("nation", "customer", "events", "supplier"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["f20_notes"](spark, str(tmp_path)).select("detection_id", "note").collect()]
    # a distance of 0.145, a double below it
    assert got == [("C000149", "Matches MMSI 316000549 at 0.14 NM; position and course consistent.")]
    assert got == con.execute(f"select detection_id, note from ({registry.ORACLE['f20_notes']}) t").fetchall()
