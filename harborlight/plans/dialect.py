"""Expressions in the two SQL dialects (Spark and DuckDB), and the domain tables derived from the TPC-H-like ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Earth radii and conversions, each operator with its own.
NM_RADIUS, KM_RADIUS, M_RADIUS, M_PER_DEG = 3440.065, 6371.0, 6371008.8, 111320.0


class Dialect:
    """Spells what the engines spell differently; all else is the SQL they share."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def pmod(self, a, b) -> str:
        return self.pick(f"pmod({a}, {b})", f"((({a}) % ({b}) + ({b})) % ({b}))")

    def seconds(self, a, b) -> str:
        return self.pick(f"(unix_micros(cast({a} as timestamp)) - unix_micros(cast({b} as timestamp))) / 1e6", f"(epoch_us({a}) - epoch_us({b})) / 1e6")

    def median(self, x) -> str:
        return f"median({x})"

    def quantile(self, x, p) -> str:
        return self.pick(f"percentile({x}, {p})", f"quantile_cont({x}, {p})")

    def upper(self, x, p) -> str:
        """The reporting quantile: the element at int(p * n) of the sorted values."""
        return self.pick(f"element_at(sort_array(collect_list({x})), cast(floor(count({x}) * {p}) as int) + 1)", f"list_sort(list({x}))[cast(floor(count({x}) * {p}) as int) + 1]")

    def argmin(self, x, by) -> str:
        return self.pick(f"min_by({x}, {by})", f"arg_min({x}, {by})")

    def argmax(self, x, by) -> str:
        return self.pick(f"max_by({x}, {by})", f"arg_max({x}, {by})")

    def struct(self, *xs) -> str:
        return self.pick(f"struct({', '.join(xs)})", f"row({', '.join(xs)})")

    def idiv(self, a, b) -> str:
        return self.pick(f"(({a}) div ({b}))", f"(({a}) // ({b}))")

    def date(self, x) -> str:
        return f"cast({x} as date)"

    def group(self, text, pattern, k=1) -> str:
        return self.pick(f"regexp_extract({text}, r'{pattern}', {k})", f"regexp_extract({text}, '{pattern}', {k})")

    def fixed(self, x, digits: int) -> str:
        """The double x with so many digits, rounded from its exact binary value and ties to even, as C's printf does.

        Java's formatter rounds the shortest decimal text of x, ties up: it has 0.125 and 0.145 as 0.13 and 0.15. So x times the power of
        ten is rounded first, where a half shows by the product's error (exact by Veltkamp's split) on which side of it x is. For x below 1e11.
        """
        if not self.spark:
            return f"printf('%.{digits}f', {x})"
        ten, p = f"1e{digits}", f"({x} * 1e{digits})"
        high = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
        error = f"(({high} * {ten} - {p}) + ({x} - {high}) * {ten})"
        return f"format_string('%.{digits}f', (case when {p} - floor({p}) = 0.5e0 then rint({p} + signum({error}) * 0.25e0) else rint({p}) end) / {ten})"

    def haversine_nm(self, a, b, c, d) -> str:
        h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
        return f"({NM_RADIUS}e0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"

    def haversine_m(self, a, b, c, d) -> str:
        h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
        return f"({M_RADIUS}e0 * 2 * asin(sqrt(least(1e0, {h}))))"

    def reckon(self, lat, lon, knots, course, hours) -> tuple[str, str]:
        ang = f"({knots} * {hours} * 1.852e0 / {KM_RADIUS}e0)"
        new = f"asin(sin(radians({lat})) * cos({ang}) + cos(radians({lat})) * sin({ang}) * cos(radians({course})))"
        lon_ = f"degrees(radians({lon}) + atan2(sin(radians({course})) * sin({ang}) * cos(radians({lat})), cos({ang}) - sin(radians({lat})) * sin({new})))"
        return f"degrees({new})", lon_

    def angle(self, a, b) -> str:
        return f"least(abs({a} - {b}) % 360e0, 360e0 - abs({a} - {b}) % 360e0)"


def _hours(q: Dialect) -> str:
    return f"({q.seconds('s.shutter_time', 'f.fix_time')} / 3600e0)"


#: Name, tables it stands on, and its SQL.
DERIVED: dict[str, Callable[[Dialect], str]] = {
    "pixels": lambda q: "select vec_id, " + q.idiv("pos", 8) + " as y, pos % 8 as x, cast(v as double) as v from " + q.pick("embeddings lateral view posexplode(embedding) e as pos, v", "(select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings) e"),
    "scenes": lambda q: "select n_nationkey as scene_key, concat('SCENE_', lpad(cast(n_nationkey as varchar(10)), 2, '0')) as scene_id, timestamp '2024-01-15 12:00:00' as shutter_time, 30.0e0 + n_nationkey*0.9e0 as center_lat, -80.0e0 + n_nationkey*1.3e0 as center_lon, 10.0e0 as gsd_m, 2048 as width, 2048 as height, cast((n_nationkey*13)%100 as double) as cloud_pct, cast((n_nationkey*7)%12 as double) / 2e0 as ice_pct, cast(40 + (n_nationkey*17)%61 as double) as water_pct, cast(70 + (n_nationkey*11)%31 as double) as valid_pct, ((n_nationkey*5)%10) * 1e-6 as blur from nation",
    "fixes": lambda q: "select e.event_id, 316000000+e.user_id as mmsi, s.scene_id, e.ts as fix_time, s.center_lat + (((e.user_id*37)%41)-20)*0.004e0 + (((e.event_id*13)%21)-10)*0.00005e0 as latitude, s.center_lon + (((e.user_id*53)%41)-20)*0.004e0 + (((e.event_id*29)%21)-10)*0.00005e0 as longitude, case when e.event_id%3=0 then 0.0e0 else round(e.value/30.0e0,1) end as sog_knots, cast((e.event_id*53)%360 as double) as cog_deg, cast(5 + (e.user_id*7)%300 as double) as length_m from {events} e join scenes s on s.scene_key = e.user_id%25",
    "contacts": lambda q: "select c_custkey as contact_key, concat('C', lpad(cast(c_custkey as varchar(10)),6,'0')) as detection_id, s.scene_id, s.center_lat + (((c_custkey*37)%41)-20)*0.004e0 + (((c_custkey*11)%21)-10)*0.0001e0 as latitude, s.center_lon + (((c_custkey*53)%41)-20)*0.004e0 + (((c_custkey*19)%21)-10)*0.0001e0 as longitude, cast((c_custkey*31)%360 as double) as heading_deg, (c_custkey%5=0) as heading_ambiguous_180, case when c_custkey%3=0 then 'VESSEL_STATIONARY_OR_SLOW' else 'VESSEL_UNDERWAY' end as target_type, case when c_custkey%3=0 then 0.0e0 else cast(60+(c_custkey*17)%900 as double) end as wake_length_m, cast((c_custkey*7)%20 as double) as wake_snr, round(0.35e0+(c_custkey%66)/100.0e0,3) as physics_score, (c_custkey*97)%2048 as x, (c_custkey*89)%2048 as y, cast(4 + (c_custkey*23)%480 as double) as hull_len_m, cast(2 + (c_custkey*29)%80 as double) as hull_wid_m, cast((c_custkey*41)%30 as double) as peak_z, (c_custkey*43)%9 as neighbours from {customer} join scenes s on s.scene_key=c_custkey%25 where c_custkey%4<>3",
    "structures": lambda q: "select s_suppkey as pos, s_name as name, s.scene_id, s.center_lat + (((s_suppkey*37)%41)-20)*0.004e0 as latitude, s.center_lon + (((s_suppkey*53)%41)-20)*0.004e0 as longitude, cast(50 + s_suppkey%400 as double) as radius_m from {supplier} join scenes s on s.scene_key = s_suppkey%25",
    "nearest_fix": lambda q: "select * from (select f.*, row_number() over (partition by f.scene_id, f.mmsi order by " + f"abs({_hours(q)})" + ", f.event_id) as pick, " + _hours(q) + " as age_h from fixes f join scenes s on s.scene_id = f.scene_id) t where pick = 1",
    "catalog": lambda q: (lambda p: f"select scene_id, mmsi, event_id, latitude, longitude, sog_knots, cog_deg, length_m, age_h, {p[0]} as plat, {p[1]} as plon, sog_knots * abs(age_h) as run_nm from nearest_fix")(q.reckon("latitude", "longitude", "sog_knots", "cog_deg", "greatest(-3e0, least(3e0, age_h))")),
    "pairs": lambda q: f"""select scene_id, detection_id, mmsi, dist, case when dist <= tight then 0 else 1 end as tier from (
        select c.scene_id, d.detection_id, c.mmsi, c.run_nm, 0.15e0 + 0.25e0 * c.run_nm as tight, least(1e0, 0.15e0 + 2e0 * c.run_nm) as wide,
          {q.haversine_nm('d.latitude', 'd.longitude', 'c.plat', 'c.plon')} as dist, {q.haversine_nm('d.latitude', 'd.longitude', 'c.latitude', 'c.longitude')} as from_fix
        from contacts d join catalog c on c.scene_id = d.scene_id and abs(c.age_h) <= 3) t where dist <= tight or (dist <= wide and abs(from_fix - run_nm) <= tight)""",
}


def walk_sql(candidates: str, left: str, right: str, order: str) -> str:
    """DuckDB's twin of greedy_match: the candidates of each scene in order, each taken if both its ends are free."""
    return f"""with recursive ranked as (select *, row_number() over (partition by scene_id order by {order}) as k from ({candidates}) cand),
  walk(scene_id, k, lefts, rights, took) as (
    select distinct scene_id, cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), false from ranked
    union all
    select scene_id, rk, case when free then list_append(lefts, l) else lefts end, case when free then list_append(rights, r) else rights end, free
    from (select w.scene_id, w.lefts, w.rights, n.k as rk, cast(n.{left} as varchar) as l, cast(n.{right} as varchar) as r, not list_contains(w.lefts, cast(n.{left} as varchar)) and not list_contains(w.rights, cast(n.{right} as varchar)) as free from walk w join ranked n on n.scene_id = w.scene_id and n.k = w.k + 1) s)
  select r.* exclude (k) from walk w join ranked r on r.scene_id = w.scene_id and r.k = w.k where w.took"""


def survivors_sql(items: str, over: str, id_: str, order: str) -> str:
    """DuckDB's twin of survivors: items of each scene in order, each kept unless a kept one outranks it."""
    return f"""with recursive ranked as (select i.*, o.above, row_number() over (partition by scene_id order by {order}) as k from ({items}) i left join (select dst, list(src) as above from ({over}) e group by dst) o on o.dst = i.{id_}),
  walk(scene_id, k, kept, took) as (
    select distinct scene_id, cast(0 as bigint), cast([] as bigint[]), false from ranked
    union all
    select scene_id, rk, case when free then list_append(kept, id) else kept end, free
    from (select w.scene_id, w.kept, n.k as rk, n.{id_} as id, n.above is null or not list_has_any(n.above, w.kept) as free from walk w join ranked n on n.scene_id = w.scene_id and n.k = w.k + 1) s)
  select r.* exclude (k, above) from walk w join ranked r on r.scene_id = w.scene_id and r.k = w.k where w.took"""


# matches come from the matching operator on Spark and from this recursive walk in DuckDB
_WALK = "select scene_id, detection_id, mmsi, dist, tier from (" + walk_sql("select * from pairs", "detection_id", "mmsi", "tier, dist, detection_id, mmsi") + ") m"
_NEEDS = {"fixes": ["scenes"], "contacts": ["scenes"], "structures": ["scenes"], "nearest_fix": ["fixes", "scenes"], "catalog": ["nearest_fix"], "pairs": ["contacts", "catalog"], "matches": ["pairs"]}


def _with(q: Dialect, sql: str) -> str:
    """sql with the derived tables it names in front."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in wanted:
            wanted.append(name)

    for name in [*DERIVED, "matches"]:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if q.spark and "matches" in wanted:
        wanted.remove("matches")
    parts = [f"{n} as ({_WALK if n == 'matches' else DERIVED[n](q)})" for n in wanted]
    parts = [re.sub(r"\{(\w+)\}", r"\1", p) for p in parts]
    own = re.match(r"\s*with (recursive )?", sql)
    head = "with recursive " if own and own[1] or "matches" in wanted else "with "
    return head + ", ".join(parts) + (", " + sql[own.end() :] if own else " " + sql) if parts else sql


def duck_sql(builder: Callable[[Dialect], str]) -> str:
    q = Dialect(False)
    return _with(q, builder(q))


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", sql)}


def _named(sql: str, tables: dict) -> str:
    """sql with the names of base tables where tables are read in braces."""
    return re.sub(r"\b(from|join)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], sql)


def frame(spark: SparkSession, sf_dir: str, sql: str, **extra: DataFrame) -> DataFrame:
    """A query over base and derived tables as a DataFrame; extra names further ones."""
    full = _with(Dialect(True), sql)
    tables = _tables(spark, sf_dir, full) | extra
    return spark.sql(_named(full, tables), **tables)


def spark_query(builder: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from harborlight.operators.matching import greedy_match

        sql = builder(Dialect(True))
        extra = {}
        if re.search(r"\bmatches\b", sql):
            pairs = frame(spark, sf_dir, "select * from pairs")
            extra["matches"] = greedy_match(pairs, "detection_id", "mmsi", ["tier", "dist", "detection_id", "mmsi"], "scene_id").select("scene_id", "detection_id", "mmsi", "dist", "tier")
        return frame(spark, sf_dir, sql, **extra)

    return query
