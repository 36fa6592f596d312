"""Catalogues of broadcasts from published formats, training samples, and choices among candidate scenes. No network is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a positional row, in order, and the message types of the two transceiver classes.
POSITIONS = ("mmsi", "time", "longitude", "latitude", "course", "speed", "message", "calculated", "seconds", "distance", "heading", "turn")
CLASS_A, CLASS_B = (1, 2, 3), (18, 19)


def _number(c: Column | str) -> Column:
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c


def _motion(course: Column, heading: Column) -> tuple[Column, Column]:
    """A valid course, else a valid heading, else 0; a valid heading or null. 511 says that there is none."""
    ahead = F.when(heading < 360, heading)
    return F.when((course >= 0) & (course < 360), course).otherwise(F.coalesce(ahead, F.lit(0.0))), ahead


def nearest(fixes: DataFrame, scenes: DataFrame, window_s: float) -> DataFrame:
    """The fix nearest in time to each scene's shutter, a scene and vessel: fixes(mmsi, at, latitude, longitude, seq, ...) inside the
    boxes of scenes(scene_id, shutter, west, east, south, north), which are few and broadcast by AQE where their size allows it.

    The day is an equality key, so rows meet the scenes of their day and the days beside it alone. Ties go to the smaller seq.
    """
    days = scenes.withColumn("day", F.explode(F.sequence(F.to_date(F.col("shutter") - F.make_dt_interval(secs=F.lit(window_s))), F.to_date(F.col("shutter") + F.make_dt_interval(secs=F.lit(window_s))))))
    apart = F.abs((F.unix_micros("at") - F.unix_micros("shutter")) / 1e6)
    inside = F.col("longitude").between(F.col("west"), F.col("east")) & F.col("latitude").between(F.col("south"), F.col("north"))
    both = fixes.withColumn("day", F.to_date("at")).join(days, "day").where(inside).withColumn("fix_age_s", apart).where(F.col("fix_age_s") <= window_s)
    best = both.groupBy("scene_id", "mmsi").agg(F.min(F.struct("fix_age_s", "seq", *[c for c in fixes.columns if c not in ("mmsi", "seq")])).alias("f"))
    return best.select("scene_id", "mmsi", "f.*")


def noaa_csv(spark: SparkSession, path: str, scenes: DataFrame, window_min: float = 20.0) -> DataFrame:
    """A broadcast catalogue from CSV days (BaseDateTime, MMSI, LAT, LON, ...); rows that don't parse are left out."""
    names = ("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "VesselType", "Length", "TransceiverClass")
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names])
    # ISO text sorts as time does, so this filter reaches the scan before anything is parsed
    lo, hi = scenes.agg(F.min("shutter") - F.make_dt_interval(mins=F.lit(int(window_min) + 1)), F.max("shutter") + F.make_dt_interval(mins=F.lit(int(window_min) + 1))).first()
    if lo is None:
        return nearest(_fix_columns(raw.limit(0)), scenes, window_min * 60)
    raw = raw.where(F.col("BaseDateTime").between(lo.strftime("%Y-%m-%dT%H:%M:%S"), hi.strftime("%Y-%m-%dT%H:%M:%S")))
    return nearest(_fix_columns(raw), scenes, window_min * 60)


def _fix_columns(raw: DataFrame) -> DataFrame:
    course, heading = _motion(F.coalesce(_number("COG"), F.lit(-1.0)), F.coalesce(_number("Heading"), F.lit(511.0)))
    named = F.trim(F.coalesce(F.when(F.col("VesselName") != "", F.col("VesselName")), F.concat(F.lit("MMSI "), F.col("MMSI"))))
    length = F.when(_number("Length") > 0, _number("Length"))
    out = raw.select(F.col("MMSI").alias("mmsi"), F.expr("try_to_timestamp(BaseDateTime)").alias("at"), _number("LAT").alias("latitude"), _number("LON").alias("longitude"), F.xxhash64(*raw.columns).alias("seq"), named.alias("name"), F.greatest(F.coalesce(_number("SOG"), F.lit(0.0)), F.lit(0.0)).alias("sog_knots"), course.alias("cog_deg"), heading.alias("heading_deg"), length.alias("length_m"), F.col("VesselType").alias("vessel_type"), F.col("TransceiverClass").alias("transceiver_class"))
    return out.where("at IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")


def positional_json(rows: DataFrame, scenes: DataFrame, static: DataFrame, window_s: float = 1200.0) -> DataFrame:
    """A broadcast catalogue from rows(value), JSON arrays in the order of POSITIONS, and static(mmsi, name, length, type)."""
    r = rows.select(F.from_json("value", "array<string>").alias("r")).where(F.size("r") >= len(POSITIONS))
    r = r.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(POSITIONS)])
    course, heading = _motion(F.coalesce(_number("course"), F.lit(-1.0)), F.coalesce(_number("heading"), F.lit(511.0)))
    message = F.expr("try_cast(message as int)")
    kind = F.when(message.isin(*CLASS_A), "A").when(message.isin(*CLASS_B), "B")
    fixes = r.select("mmsi", F.expr("try_to_timestamp(time)").alias("at"), _number("latitude").alias("latitude"), _number("longitude").alias("longitude"), F.xxhash64(*POSITIONS).alias("seq"), F.greatest(F.coalesce(_number("speed"), F.lit(0.0)), F.lit(0.0)).alias("sog_knots"), course.alias("cog_deg"), heading.alias("heading_deg"), kind.alias("transceiver_class"))
    got = nearest(fixes.where("at IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"), scenes, window_s)
    s = static.select(F.col("mmsi").cast("string").alias("mmsi"), F.trim("name").alias("name"), F.when(F.col("length") > 0, F.col("length").cast("double")).alias("length_m"), F.col("type").alias("vessel_type"))
    return got.join(s, "mmsi", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("MMSI "), F.col("mmsi"))))


def boxes_of(manifest_scenes: DataFrame, margin_deg: float) -> DataFrame:
    """Boxes around scenes(scene_id, shutter, west, east, south, north), as wide in kilometres east as north."""
    wide = margin_deg / F.greatest(F.cos(F.radians((F.col("south") + F.col("north")) / 2)), F.lit(0.05))
    return manifest_scenes.select("scene_id", "shutter", (F.col("west") - wide).alias("west"), (F.col("east") + wide).alias("east"), (F.col("south") - margin_deg).alias("south"), (F.col("north") + margin_deg).alias("north"))


def choose_scene(candidates: DataFrame, max_empty_pct: float = 15.0) -> DataFrame:
    """Of candidates(aoi, item, cloud_pct, empty_pct), the clearest of each area whose window is covered."""
    return candidates.where(F.col("empty_pct") <= max_empty_pct).groupBy("aoi").agg(F.min(F.struct(F.coalesce("cloud_pct", F.lit(100.0)).alias("cloud_pct"), "item")).alias("m")).select("aoi", "m.item", "m.cloud_pct")


def samples(spark: SparkSession, csv_path: str) -> DataFrame:
    """Training samples of a CSV (image, product, boxes): one row a box, `x0 y0 x1 y1` separated by semicolons; held_out by product."""
    d = spark.read.option("header", True).schema("image string, product string, boxes string").csv(csv_path)
    d = d.withColumn("held_out", F.crc32(F.col("product").cast("binary")) % 4 == 0).withColumn("box", F.explode_outer(F.split("boxes", ";")))
    p = F.split(F.trim("box"), " +")
    return d.select("image", "product", "held_out", *[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def withheld(vessels: DataFrame) -> DataFrame:
    """vessels with `withheld`: every third MMSI by its CRC-32, so a bundle can be scored on broadcasters it does not tell of."""
    return vessels.withColumn("withheld", F.crc32(F.col("mmsi").cast("string").cast("binary")) % 3 == 0)
