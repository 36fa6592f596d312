import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.kernels import raster
from harborlight.operators.matching import greedy_match, mutual_best_match
from harborlight.operators.memory import fold
from harborlight.operators.near import cell_join
from harborlight.operators.thermal import advance, Bus, govern
from harborlight.sources import bundle, sinks
from harborlight.streaming.live import dispatch_to, latest_verdicts


def test_scalar_anchors(spark):
    r = spark.range(1).select(geo.haversine_nm(F.lit(44.0), F.lit(-63.0), F.lit(44 + 1 / 60), F.lit(-63.0)).alias("a"), geo.kelvin_knots(F.lit(64.07)).alias("k"), geo.angular_difference(F.lit(350.0), F.lit(10.0)).alias("d"), *[c.alias(n) for n, c in zip(("lat", "lon"), geo.dead_reckon(F.lit(0.0), F.lit(0.0), F.lit(12.0), F.lit(90.0), F.lit(0.5)))]).first()
    assert abs(r.a - 1.0) < 0.01 and abs(r.k - 19.44) < 0.02 and r.d == 20 and abs(r.lon * 60 - 6) < 0.01 and abs(r.lat) < 1e-9


def test_matchings_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(a), int(b), float(rng.integers(0, 6))) for g in range(4) for a in range(9) for b in range(7) if rng.random() < 0.5]
    pairs = spark.createDataFrame(rows, "g long, a long, b long, d double")
    one, two = (set(map(tuple, f(pairs, "a", "b", ["d", "a", "b"], "g").collect())) for f in (greedy_match, mutual_best_match))
    assert one == two and one


def test_cell_join_wraps_and_finds_all(spark):
    rng = np.random.default_rng(2)
    pts = [(int(i), float(rng.uniform(-70, 70)), float(rng.uniform(-180, 180))) for i in range(300)] + [(1000, 10.0, 179.999), (1001, 10.0, -179.999)]
    d = spark.createDataFrame(pts, "i long, latitude double, longitude double")
    got = {(r.i, r.j) for r in cell_join(d, d, 30.0).select(F.col("l.i").alias("i"), F.col("r.i").alias("j")).collect()}
    x = d.alias("x").crossJoin(d.alias("y")).where(geo.haversine_nm(F.col("x.latitude"), F.col("x.longitude"), F.col("y.latitude"), F.col("y.longitude")) <= 30.0)
    assert got == {(r[0], r[1]) for r in x.select("x.i", "y.i").collect()} and (1000, 1001) in got


def _passes(days):
    return pd.DataFrame([(i, 44.0 + 1e-4 * i, -63.0, datetime.date.fromisoformat(d) if d else None) for i, d in enumerate(days)], columns=["seq", "latitude", "longitude", "date"])


@pytest.mark.parametrize("days, passes", [(["2024-01-01", "2024-01-02", "2024-01-03"], 3), (["2024-01-01"] * 10 + [None], 1), ([None], None), (["2024-01-01", "2024-01-02", "2024-01-03", "2024-12-01"], 1)])
def test_memory(days, passes):
    got = fold(_passes(days))
    assert (len(got[0]["dates"]) if got else None) == passes


def test_thermal_is_bounded_and_sunlight_heats():
    dark, lit = (advance(20, 20, 20_000, 25, s, Bus()) for s in (False, True))
    assert lit[0] > dark[0] and lit[1] < lit[0] < 150


def _law(seconds, p, profile="FULL", act=True):
    """The control law stage by stage, by forward simulation alone: (profile in force, chosen, junction, chassis) after each."""
    names, watts = ["FULL", "REDUCED", "SURVEY", "BEACON"], [25.0, 15.0, 15.0, 10.0]
    step = lambda s, w, lit, h: (s[0] + h * (w - (s[0] - s[1]) / p.r_k_per_w) / p.soc_j_per_k, s[1] + h * ((s[0] - s[1]) / p.r_k_per_w + (p.absorptivity * 1361 * p.area if lit else 0) + p.parasitic_w - p.emissivity * 5.670374419e-8 * p.area * ((s[1] + 273.15) ** 4 - 2.7**4)) / p.chassis_j_per_k)
    state, at, out = (p.junction_c, p.chassis_c), 0.0, []
    for sec in seconds:
        lit, left = (at / p.period_s) % 1 >= p.eclipse, sec
        while left > 1e-9:
            state, left = step(state, watts[names.index(profile)], lit, min(5.0, left)), left - min(5.0, left)
        at += sec
        lit, pick = (at / p.period_s) % 1 >= p.eclipse, "BEACON"
        if state[0] < p.throttle_c:
            for n, w in zip(names, watts):
                s, t, hold = state, 0, None
                while t < 60_000:  # far past every time constant
                    s, t = step(s, w, lit, 5.0), t + 5
                    if hold is None and s[0] >= p.throttle_c:
                        hold = t
                need = (1 - (at / p.period_s) % 1) * p.period_s + 300 if 0 < p.eclipse < 1 else float("inf")
                hold = 11_352 if hold is None or hold > 11_352 else hold
                if s[0] < p.target_c or lit and p.throttle_c - state[0] >= 12 and hold >= need:
                    pick = n
                    break
        if act and not (names.index(pick) < names.index(profile) and p.throttle_c - state[0] < 20):
            profile = pick
        out.append((profile, pick, round(state[0], 6), round(state[1], 6)))
    return out


@pytest.mark.parametrize("bus", [Bus(), Bus(eclipse=0.0), Bus(area=0.07), Bus(area=0.05, soc_j_per_k=60.0), Bus(parasitic_w=25.0, junction_c=60.0, chassis_c=50.0), Bus(junction_c=97.0, chassis_c=60.0), Bus(area=0.08, period_s=2000.0)])
def test_governor_follows_the_control_law(spark, bus):
    seconds = [float(x) for x in np.random.default_rng(7).choice([1.0, 33.0, 210.0, 900.0], 40)]
    stages = spark.createDataFrame([("k", i, x) for i, x in enumerate(seconds)], "k string, seq long, seconds double").coalesce(1)
    for kw, law in (({}, {}), ({"enabled": False}, {"act": False}), ({"pin": "SURVEY"}, {"act": False, "profile": "SURVEY"})):
        got = [(r.profile, r.chosen, round(r.junction_c, 6), round(r.chassis_c, 6)) for r in govern(stages, "k", bus, **kw).orderBy("seq").collect()]
        assert got == _law(seconds, bus, **law)


def test_governor_sheds_to_the_floor_and_takes_cores(spark):
    stages = spark.createDataFrame([("k", 0, 1.0, 0.0), ("k", 1, None, None)], "k string, seq long, seconds double, cores_busy double")
    hot, still = govern(stages, "k", Bus(junction_c=97.0, chassis_c=96.0)).orderBy("seq").collect()
    assert (hot.profile, still.profile) == ("BEACON", "BEACON") and still.elapsed_s == 1.0
    assert abs(hot.junction_c - (97.0 + (4.0 - 1 / 0.9) / 120)) < 1e-9
    with pytest.raises(ValueError):
        govern(stages, "k", pin="HALF")


def test_bundle_quarantines(spark, tmp_path):
    bundle.write_bundle(str(tmp_path))
    got = {r.scene_id: r for r in bundle.detect(spark, str(tmp_path)).collect()}
    assert len(got["SEA"].contacts) == 3 and got["SEA"].error is None
    assert got["TINY"].error == "EMPTY_OR_TINY_RASTER" and got["GONE"].error == "FILE_NOT_FOUND" and got["BAD"].error.startswith("DECODE_ERROR")
    assert [r.mmsi for r in bundle.vessels(spark, str(tmp_path)).collect()] == ["316000001"]


def test_components():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert raster.components(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 4]]
    assert raster.components(np.zeros((2, 2), bool)).max() == 0 and raster.components(np.ones((2, 2), bool)).tolist() == [[1, 1], [1, 1]]


def test_archive_is_reproducible_and_sealing_round_trips(spark, tmp_path):
    for n in "ab":
        sinks.write_archive(str(tmp_path / n), {"x": b"1", "w": b"22"})
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    d = spark.createDataFrame([(bytearray(b"hello"), "n.jpg")], "c binary, name string").select("name", "c", sinks.seal(F.col("c"), F.lit(b"0" * 32), F.col("name")).alias("s"))
    r = d.select(F.length("s").alias("n"), sinks.unseal(F.col("s"), F.lit(b"0" * 32), F.col("name")).alias("back")).first()
    assert bytes(r.back) == b"hello" and r.n == 3 + 12 + 5 + 16


def test_label_stream_and_dispatch(spark, tmp_path):
    rows = [(1, "a", "x", "vessel"), (3, "b", "x", "not_vessel"), (2, "a", "x", "unsure"), (9, "__bot", "x", "vessel"), (1, "a", "__t", "vessel")]
    spark.createDataFrame(rows, "ts long, labeller string, id string, verdict string").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("ts long, labeller string, id string, verdict string").parquet(str(tmp_path / "log"))
    q = latest_verdicts(log).writeStream.outputMode("complete").format("memory").queryName("verdicts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select id, verdict, ts from verdicts").collect()] == [("x", "not_vessel", 3)]
    send, batch = dispatch_to(str(tmp_path / "sent")), spark.createDataFrame([("f1",), ("f2",), ("f1",)], "source_filename string")
    send(batch, 0)
    send(batch, 0)
    assert spark.read.parquet(str(tmp_path / "sent")).count() == 2
