"""Bundles, connectors, packages, streams and the command line."""

import datetime
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.__main__ import main
from harborlight.operators import memory
from harborlight.plans import stages
from harborlight.sources import bundle, connectors, sinks
from harborlight.streaming import live


def test_bundle_edges(spark, tmp_path):
    with pytest.raises(bundle.InvalidManifestError):
        bundle.scenes(spark, str(tmp_path / "none"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("[1")
    with pytest.raises(bundle.InvalidManifestError):
        bundle.scenes(spark, str(tmp_path / "broken"))
    d = tmp_path / "plain"
    d.mkdir()
    for n in ("b", "a"):
        np.save(d / f"{n}.npy", np.full((32, 32, 4), 0.05, np.float32))
    assert sorted(r.scene_id for r in bundle.scenes(spark, str(d)).collect()) == ["a", "b"]
    two = tmp_path / "two"
    for n in ("x", "y"):
        (two / n).mkdir(parents=True)
        np.save(two / n / "sea.npy", np.full((32 if n == "x" else 48, 32, 4), 0.05, np.float32))
    (two / "manifest.json").write_text(json.dumps({"scenes": [{"id": n, "file": f"{n}/sea.npy"} for n in "xy"] + [{"id": "z", "file": "../plain/a.npy"}]}))
    got = {r.scene_id: (r.height, r.error) for r in bundle.detect(spark, str(two)).collect()}
    assert got == {"x": (32, None), "y": (48, None), "z": (None, "FILE_NOT_FOUND")}
    (two / "known_structures.json").write_text(json.dumps({"structures": [{"name": "rig", "latitude": 1, "longitude": 2}, {"name": "lost"}]}))
    assert [tuple(r) for r in bundle.structures(spark, str(two)).collect()] == [(0, "rig", 1.0, 2.0, 150.0)]
    assert bundle.bundles(str(tmp_path)) == sorted([str(tmp_path / "broken"), str(two)])


def _scenes(spark):
    return spark.createDataFrame([("s", datetime.datetime(2024, 1, 15, 12, 0), -64.0, -63.0, 44.0, 45.0)], "scene_id string, shutter timestamp, west double, east double, south double, north double")


def test_broadcast_csv(spark, tmp_path):
    rows = ["MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,Length", "1,2024-01-15T11:50:00,44.5,-63.5,5.0,400,511,,0", "1,2024-01-15T12:05:00,44.6,-63.5,-1,400,90,ALPHA,12", "2,2024-01-15T13:00:00,44.5,-63.5,1,2,3,LATE,1", "3,2024-01-15T12:00:00,x,-63.5,1,2,3,BAD,1", "4,2024-01-15T12:00:00,44.5,-10,1,2,3,FAR,1"]
    (tmp_path / "day.csv").write_text("\n".join(rows))
    (r,) = connectors.noaa_csv(spark, str(tmp_path / "day.csv"), _scenes(spark)).collect()
    assert (r.mmsi, r.name, r.sog_knots, r.cog_deg, r.heading_deg, r.length_m, r.fix_age_s) == ("1", "ALPHA", 0.0, 90.0, 90.0, 12.0, 300.0)


def test_positional_rows(spark):
    row = lambda m, t, msg, cog=10: json.dumps([m, t, -63.5, 44.5, cog, 3.5, msg, 0, 0, 0, 511, 0])
    rows = spark.createDataFrame([(row(7, "2024-01-15T12:01:00", 18),), (row(7, "2024-01-15T11:58:00", 1),), (row(8, "2024-01-15T12:00:30", 2, 999),), (row(9, "never", 1),), ("[1]",)], "value string")
    static = spark.createDataFrame([(7, " SEVEN ", 0.0, "cargo")], "mmsi long, name string, length double, type string")
    got = {r.mmsi: r for r in connectors.positional_json(rows, _scenes(spark), static).collect()}
    assert set(got) == {"7", "8"} and (got["7"].name, got["7"].transceiver_class, got["7"].length_m) == ("SEVEN", "B", None)
    assert (got["8"].name, got["8"].cog_deg, got["8"].transceiver_class) == ("MMSI 8", 0.0, "A")


def test_samples_and_withheld(spark, tmp_path):
    (tmp_path / "s.csv").write_text('image,product,boxes\na,P1,1 2 3 4;5 6 7 8\nb,P2,\n')
    got = [tuple(r) for r in connectors.samples(spark, str(tmp_path / "s.csv")).orderBy("image", "x0").collect()]
    held = lambda p: zlib.crc32(p.encode()) % 4 == 0
    assert got == [("a", "P1", held("P1"), 1, 2, 3, 4), ("a", "P1", held("P1"), 5, 6, 7, 8), ("b", "P2", held("P2"), None, None, None, None)]
    v = connectors.withheld(spark.range(50).select((F.col("id") + 316000000).alias("mmsi")))
    assert all(r.withheld == (zlib.crc32(str(r.mmsi).encode()) % 3 == 0) for r in v.collect())


def _package(spark, folder):
    t = spark.createDataFrame([("b", 0.9, 1.0, 2.0, "DARK_VESSEL"), ("a", 0.9, 1.0, 2.0, "DARK_VESSEL"), ("c", 0.1, 1.0, 2.0, "KNOWN")], "detection_id string, priority double, latitude double, longitude double, classification string")
    u = spark.createDataFrame([("5", 1.0, 2.0, "CLEAR_WATER_NO_TARGET"), ("6", 1.0, 2.0, "UNDER_CLOUD")], "mmsi string, latitude double, longitude double, reason string")
    s = spark.createDataFrame([("s1", 80.0)], "scene_id string, valid_pct double")
    bad = spark.createDataFrame([("s0", "DECODE_ERROR")], "scene_id string, error string")
    chips = spark.createDataFrame([("b", 0.9, b"x" * 900), ("a", 0.8, b"y" * 900), ("c", 0.1, b"z")], "detection_id string, priority double, content binary")
    return sinks.package(str(folder), t, u, s, bad, chips, budget=3500)


def test_package_is_reproducible_and_within_budget(spark, tmp_path):
    m = _package(spark, tmp_path / "1")
    assert m == _package(spark, tmp_path / "2") and (tmp_path / "1/downlink.tar.gz").read_bytes() == (tmp_path / "2/downlink.tar.gz").read_bytes()
    geo = json.loads((tmp_path / "1/contacts.geojson").read_bytes())
    assert [f["properties"]["detection_id"] for f in geo["features"]] == ["a", "b", "c", "5"] and geo["metadata"]["not_observed"] == {"CLEAR_WATER_NO_TARGET": 1, "UNDER_CLOUD": 1}
    assert [s["status"] for s in json.loads((tmp_path / "1/scene_report.json").read_bytes())["scenes"]] == ["rejected", "screened"]
    assert "chips/b.bin" in m["files"] and "chips/c.bin" not in m["files"]
    assert sum(f["bytes"] for f in m["files"].values()) + 1024 <= 3500


def test_memory_file_and_key(tmp_path, monkeypatch):
    path = str(tmp_path / "m.json")
    assert sinks.read_memory(path) == []
    sinks.write_memory(path, [{"latitude": 2, "longitude": 1, "passes": 3}, {"latitude": 1, "longitude": 1, "passes": None}])
    assert sinks.read_memory(path) == [{"latitude": 2, "longitude": 1, "passes": 3}]
    (tmp_path / "m.json").write_text("{")
    assert sinks.read_memory(path) == []
    key = sinks.communications_key(str(tmp_path / "key"))
    assert len(key) == 32 and sinks.communications_key(str(tmp_path / "key")) == key and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    monkeypatch.setenv("HARBORLIGHT_KEY", "AAAA")
    with pytest.raises(ValueError):
        sinks.communications_key("unused")
    assert sinks.telemetry(2_000_000, 1000, 2.0, 3.0, 1433.6)["reduction_ratio"] == 2000.0


def _stream(spark, tmp_path, name, df, query, mode, files=2):
    """Rows that a query gives over df read as a stream, a file a batch in df's order."""
    schema, out = df.schema, []
    for k in range(files):
        df.where(F.col("batch") == k).coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    q = query(s).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-ck")).foreachBatch(lambda b, i: out.append((i, [tuple(r) for r in b.collect()]))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def test_stage_change_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(0, at(0), "a", "queue"), (0, at(0), "b", "queue"), (0, at(1), "a", "queue"), (1, at(2), "a", "sent"), (1, at(2), "b", "queue")]
    df = spark.createDataFrame(rows, "batch int, ts timestamp, filename string, stage string")
    got = _stream(spark, tmp_path, "stages", df, lambda s: live.stage_changes(s), "append")
    assert sorted(got[0]) == [("a", at(0), None, "queue"), ("b", at(0), None, "queue")] and got[1] == [("a", at(2), "queue", "sent")]


def test_memory_stream_equals_the_batch_fold(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [(k // 3, "r", k, 44.0 + 0.0001 * k, -63.0, day(1 + 2 * k)) for k in range(6)] + [(1, "r", 9, 50.0, -60.0, day(20))]
    df = spark.createDataFrame(rows, "batch int, region string, seq long, latitude double, longitude double, date date")
    got = _stream(spark, tmp_path, "memory", df, lambda s: live.remembered(s, "region"), "update")
    want = [tuple(r) for r in memory.remember(df, "region").collect()]
    assert sorted(got[-1]) == sorted(want) and max(r[3] for r in want) == 6


def test_send_order(spark):
    rows = [("priority", f"p{i}", 10) for i in range(7)] + [("other", f"o{i}", 10) for i in range(3)]
    got = [r.name for r in live.send_order(spark.createDataFrame(rows, "queue string, name string, bytes long")).orderBy("sent").collect()]
    assert got == ["p0", "p1", "p2", "o0", "p3", "p4", "p5", "o1", "p6", "o2"]


def test_dispatch_runs_twice_and_sends_once(spark, tmp_path):
    send, path = live.dispatch_to(str(tmp_path / "sent")), str(tmp_path / "sent")
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "source_filename string")
    send(batch, 0)
    send(batch, 0)
    send(spark.createDataFrame([("b",), ("c",)], "source_filename string"), 1)
    assert sorted(r.source_filename for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_command_line(spark, tmp_path, capsys):
    bundle.write_bundle(str(tmp_path / "in"))
    assert main(["run", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 0
    geo = json.loads((tmp_path / "out/contacts.geojson").read_bytes())
    assert len(geo["features"]) == 3 and "contacts.geojson" in capsys.readouterr().out
    assert main(["run", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "q"), "-t", "quality"]) == 0
    assert json.loads((tmp_path / "q/contacts.geojson").read_bytes())["features"] == []
    assert main(["run", "-i", str(tmp_path / "gone"), "-o", str(tmp_path / "x")]) == 2
    assert main(["run", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "x"), "-t", "nothing"]) == 2
    assert stages.Config.load(str(tmp_path / "none.yaml")) == stages.Config()
    (tmp_path / "c.json").write_text('{"max_cloud_pct": 20, "other": 1}')
    c = stages.Config.load(str(tmp_path / "c.json"))
    assert c.max_cloud_pct == 20 and c.extra == {"other": 1}
