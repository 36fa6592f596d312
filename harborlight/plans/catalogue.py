"""Queries that both dialects spell; the name starts with the operator's ID in the survey."""

from __future__ import annotations

from collections.abc import Callable

from .dialect import Dialect

# 21 patrol groups with the centres of their areas.
FLEETS = (("gibraltar", 36.04, -5.35), ("suez", 29.86, 32.54), ("longbeach", 33.71, -118.20), ("halifax", 44.60, -63.54), ("dover", 51.01, 1.39), ("singapore", 1.30, 104.01), ("newyork", 40.45, -73.91), ("norfolk", 36.92, -76.05), ("galveston", 29.27, -94.74), ("tampa", 27.57, -82.79), ("savannah", 31.95, -80.84), ("charleston", 32.65, -79.79), ("sanfrancisco", 37.78, -122.64), ("pugetsound", 48.13, -122.64), ("miami", 25.72, -80.12), ("mississippi", 28.91, -89.34), ("boston", 42.30, -70.89), ("delaware", 38.77, -75.04), ("corpus", 27.77, -97.04), ("honolulu", 21.25, -157.94), ("sandiego", 32.62, -117.29))
_FLEETS = "(select * from (values " + ", ".join(f"({i}, '{n}', {a}e0, {b}e0)" for i, (n, a, b) in enumerate(FLEETS)) + ") as v(pos, fleet, latitude, longitude)) fl"
_CONF = "round(least(1e0, physics_score), 3)"
_SIZE = "case when hull_len_m < 25 then 'SMALL_CRAFT' when hull_len_m < 100 then 'MEDIUM_VESSEL' when hull_len_m < 250 then 'LARGE_VESSEL' else 'VERY_LARGE_VESSEL' end"

#: Candidates a scene that the configuration allows, and that each profile of the governor does.
CANDIDATES, PROFILE_CANDIDATES = 400, {"FULL": 400, "REDUCED": 250, "SURVEY": 120, "BEACON": 60}


def candidate_cap(profile: str = "FULL", configured: int = CANDIDATES) -> Callable[[Dialect], str]:
    """The largest candidates of each scene, as many as both the configuration and the profile allow."""
    cap = min(configured, PROFILE_CANDIDATES[profile])
    return lambda q: f"select detection_id from (select detection_id, row_number() over (partition by scene_id order by hull_len_m desc, y, x, detection_id) as k from contacts) t where k <= {cap}"


def problems(q: Dialect) -> str:
    """Matched contacts with the three ways they can contradict the broadcast (as flags) next to what does not match."""
    delta = q.angle("d.heading_deg", "c.cog_deg")
    delta = f"case when d.heading_ambiguous_180 then least({delta}, 180e0 - {delta}) else {delta} end"
    return f"""select d.detection_id, d.scene_id, d.physics_score, d.target_type, m.mmsi, m.dist, m.tier, st.name as structure,
      m.mmsi is not null and m.tier = 1 as off_track,
      m.mmsi is not null and d.target_type <> 'VESSEL_STATIONARY_OR_SLOW' and c.sog_knots >= 2 and {delta} > 35 as bad_course,
      m.mmsi is not null and d.target_type = 'VESSEL_UNDERWAY' and c.sog_knots < 0.5e0 and d.wake_length_m >= 300 and d.wake_snr >= 8 as bad_speed
      from contacts d left join matches m on m.detection_id = d.detection_id
      left join catalog c on c.scene_id = m.scene_id and c.mmsi = m.mmsi
      left join (select d2.detection_id, {q.argmin('s2.name', 's2.pos')} as name from contacts d2 join structures s2 on s2.scene_id = d2.scene_id and {q.haversine_nm('d2.latitude', 'd2.longitude', 's2.latitude', 's2.longitude')} <= s2.radius_m / 1852e0 group by d2.detection_id) st on st.detection_id = d.detection_id"""


def targets(q: Dialect) -> str:
    return f"""select detection_id, scene_id, mmsi, cast(round(dist, 3) as double) as ais_distance_nm, classification,
      case classification when 'AIS_KINEMATIC_MISMATCH' then round(0.60e0 + 0.25e0 * physics_score, 3) when 'CONFIRMED_KNOWN_VESSEL' then 0.10e0 when 'KNOWN_STRUCTURE' then 0.05e0 else round(0.70e0 + 0.30e0 * physics_score, 3) end as priority
      from (select *, case when mmsi is not null and (off_track or bad_course or bad_speed) then 'AIS_KINEMATIC_MISMATCH' when mmsi is not null then 'CONFIRMED_KNOWN_VESSEL' when structure is not null then 'KNOWN_STRUCTURE' else 'DARK_VESSEL' end as classification from ({problems(q)}) p) t"""


def running(src: str, groups: dict[str, str], outer: str, inner: str, value: str = "1") -> str:
    """src with `k`, the running sum of value in the order (outer, inner), where outer orders the groups and inner the rows in one.

    Rows are ordered a group a task; only the groups' totals, one row a group, are ordered in a single task.
    """
    names, made = ", ".join(groups), ", ".join(f"{e} as {n}" for n, e in groups.items())
    totals = f"select {names}, coalesce(sum(n) over (order by {outer} rows between unbounded preceding and 1 preceding), 0) as before from (select {names}, sum({value}) as n from (select *, {made} from ({src}) s0) s1 group by {names}) s2"
    same = " and ".join(f"o.{n} = r.{n}" for n in groups)
    return f"select r.*, o.before + sum({value}) over (partition by {', '.join('r.' + n for n in groups)} order by {inner} rows unbounded preceding) as k from (select *, {made} from ({src}) s3) r join ({totals}) o on {same}"


Q: dict = {}


# --- joins and matching
Q["q_pass"] = lambda q: f"select *, row_number() over (order by priority desc, detection_id) as rank from ({targets(q)}) z"
Q["j1_band_join"] = lambda q: "select scene_id, detection_id, mmsi, tier, round(dist, 6) as dist from pairs"
Q["j2_greedy_match"] = lambda q: "select scene_id, detection_id, mmsi, tier, round(dist, 6) as dist from matches"
Q["j3_left_join_targets"] = lambda q: "select d.detection_id, m.mmsi, coalesce(m.tier, -1) as tier from contacts d left join matches m on m.detection_id = d.detection_id"
Q["j4_first_structure"] = lambda q: f"select d.detection_id, {q.argmin('s.name', 's.pos')} as structure, count(*) as within from contacts d join structures s on s.scene_id = d.scene_id and {q.haversine_nm('d.latitude', 'd.longitude', 's.latitude', 's.longitude')} <= s.radius_m / 1852e0 group by d.detection_id"
_PX = "(c.plon - (s.center_lon - (s.width / 2e0) * s.gsd_m / (111320e0 * greatest(cos(radians(s.center_lat)), 1e-6)))) / (s.width * s.gsd_m / (111320e0 * greatest(cos(radians(s.center_lat)), 1e-6))) * (s.width - 1)"
_PY = "((s.center_lat + (s.height / 2e0) * s.gsd_m / 111320e0) - c.plat) / (s.height * s.gsd_m / 111320e0) * (s.height - 1)"
Q["j5_unobserved"] = lambda q: f"select scene_id, mmsi, round(plat, 6) as predicted_lat, round(plon, 6) as predicted_lon, case when {q.pmod('floor(px / 64)', 7)} = 0 then 'UNDER_CLOUD' when {q.pmod('floor(py / 64)', 11)} = 0 then 'IN_PORT_OR_SHORE_KEEPOUT' when length_m > 0 and length_m < 2.5e0 * gsd_m then 'BELOW_SENSOR_RESOLUTION' else 'CLEAR_WATER_NO_TARGET' end as reason from (select c.*, s.gsd_m, s.width, s.height, {_PX} as px, {_PY} as py from catalog c join scenes s on s.scene_id = c.scene_id where abs(c.age_h) <= 3 and not exists (select 1 from matches m where m.scene_id = c.scene_id and m.mmsi = c.mmsi)) t where px >= 0 and px < width and py >= 0 and py < height"
Q["j6_nearest_fix"] = lambda q: "select scene_id, mmsi, event_id, round(age_h, 6) as age_h from nearest_fix"
Q["j7_site_probe"] = lambda q: f"select site, count(*) as fixes, count(distinct mmsi) as vessels from (select s.scene_id as site, f.mmsi, row_number() over (partition by s.scene_id, f.mmsi order by abs({q.seconds('s.shutter_time', 'f.fix_time')}), f.event_id) as pick from scenes s join fixes f on f.latitude between s.center_lat - 1.5e0 and s.center_lat + 1.5e0 and f.longitude between s.center_lon - 2e0 and s.center_lon + 2e0) t where pick = 1 group by site"
Q["j8_nearest_fleet"] = lambda q: f"select detection_id, fleet, round(nm, 6) as nm from (select d.detection_id, fl.fleet, {q.haversine_nm('d.latitude', 'd.longitude', 'fl.latitude', 'fl.longitude')} as nm, row_number() over (partition by d.detection_id order by {q.haversine_nm('d.latitude', 'd.longitude', 'fl.latitude', 'fl.longitude')}, fl.pos) as pick from contacts d cross join {_FLEETS}) t where pick = 1"
_NEAR = "select d.detection_id, f.pos, {d} as m, f.radius_m * 20 as gate from contacts d left join structures f on f.scene_id = d.scene_id"
Q["j9_rf_association"] = lambda q: f"select detection_id, coalesce({q.pick('bool_or(m <= gate)', 'bool_or(m <= gate)')}, false) as retained, {q.argmin('pos', 'm')} as emitter from ({_NEAR.format(d=q.haversine_m('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude'))}) t group by detection_id"
Q["j13_suppression"] = lambda q: f"select d.detection_id from contacts d where exists (select 1 from structures s where s.scene_id = d.scene_id and {q.haversine_nm('d.latitude', 'd.longitude', 's.latitude', 's.longitude')} <= 0.08e0) and not exists (select 1 from catalog c where c.scene_id = d.scene_id and {q.haversine_nm('d.latitude', 'd.longitude', 'c.plat', 'c.plon')} <= 0.08e0)"
Q["j14_first_record"] = lambda q: "select mmsi, event_id, round(latitude, 6) as latitude from (select *, row_number() over (partition by mmsi order by event_id) as pick from fixes) t where pick = 1"
Q["j15_scene_attributes"] = lambda q: "select d.detection_id, s.gsd_m, s.cloud_pct from contacts d join scenes s on s.scene_id = d.scene_id"
Q["j16_verdicts"] = lambda q: f"select t.detection_id, case when t.mmsi is not null then 'vessel' when l.quality = 1 and l.toxic = 0 then 'vessel' when l.quality = 0 then 'not_vessel' when l.toxic = 1 then 'structure' else 'unsure' end as verdict from ({targets(q)}) t join contacts d on d.detection_id = t.detection_id left join labels l on l.doc_id = d.contact_key"
Q["j18_nearest_contact"] = lambda q: f"select c.scene_id, c.mmsi, {q.argmin('d.detection_id', q.struct(q.haversine_nm('d.latitude', 'd.longitude', 'c.plat', 'c.plon'), 'd.detection_id'))} as detection_id from catalog c join contacts d on d.scene_id = c.scene_id group by c.scene_id, c.mmsi"
Q["j19_min_distance"] = lambda q: f"select d.detection_id, round(min({q.haversine_m('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude')}), 3) as metres from contacts d left join structures f on f.scene_id = d.scene_id group by d.detection_id"
Q["j20_agreement"] = lambda q: "select conv_id, count(distinct verdict) as verdicts, count(distinct role) as labellers from (select conv_id, role, case length(text) % 4 when 0 then 'vessel' when 1 then 'not_vessel' when 2 then 'structure' else 'unsure' end as verdict from conversations) t where verdict <> 'unsure' group by conv_id having count(distinct role) > 1"
Q["j21_reference_run"] = lambda q: f"select {q.argmax('scene_id', q.struct('n', 'scene_id'))} as scene_id, max(n) as overlap from (select scene_id, count(*) as n from contacts where contact_key in (select doc_id from labels) group by scene_id) t"
# --- predicates and projections
Q["p1_scene_usable"] = lambda q: "select scene_id, case when valid_pct < 75 then 'NODATA' else '' end as r1, case when cloud_pct > 60 then 'CLOUD' else '' end as r2, case when blur < 2e-6 then 'BLUR' else '' end as r3, case when water_pct < 5 and valid_pct >= 75 and cloud_pct <= 60 and blur >= 2e-6 then 'NO_OPEN_WATER' else '' end as r4, valid_pct >= 75 and cloud_pct <= 60 and blur >= 2e-6 and water_pct >= 5 as is_usable from scenes"
Q["p2_area_gate"] = lambda q: "select detection_id, neighbours * 30 as area_px from contacts where neighbours * 30 between greatest(3, 1) and 200"
Q["p4_rough_sea"] = lambda q: f"select d.detection_id from contacts d join (select x.scene_id, exp(max(x.med) + 5 * greatest(1.4826e0 * {q.median('abs(ln(d.physics_score) - x.med)')}, 0.15e0)) as gate, count(*) as n from contacts d join (select scene_id, {q.median('ln(physics_score)')} as med from contacts group by scene_id) x on x.scene_id = d.scene_id group by x.scene_id) g on g.scene_id = d.scene_id where g.n < 8 or d.physics_score >= g.gate or d.hull_len_m >= 120"
Q["p5_physics_gate"] = lambda q: "select detection_id from contacts where physics_score >= 0.35e0 and not (wake_length_m > 0 and hull_len_m < 6)"
Q["p6_ice_gate"] = lambda q: "select d.detection_id from contacts d join scenes s on s.scene_id = d.scene_id where s.ice_pct < 2 or d.wake_length_m >= 150"
Q["p7_verifier_reject"] = lambda q: "select detection_id, wake_snr / 20e0 < 0.80e0 and physics_score < 0.95e0 as rejected from contacts"
Q["p8_stale_fix"] = lambda q: "select scene_id, mmsi from nearest_fix where abs(age_h) > 3"
Q["p9_chip_eligible"] = lambda q: f"select detection_id from ({targets(q)}) t where priority >= 0.5e0"
Q["p10_queue_route"] = lambda q: f"select detection_id, case when mmsi is not null then 'nonPriority' else 'priority' end as queue from ({targets(q)}) t"
Q["p11_time_window"] = lambda q: "select event_id from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00'"
Q["p12_bbox"] = lambda q: "select f.event_id, s.scene_id from fixes f join scenes s on s.scene_id = f.scene_id where f.latitude between s.center_lat - 0.05e0 and s.center_lat + 0.05e0 and f.longitude between s.center_lon - 0.05e0 / greatest(cos(radians(s.center_lat)), 0.05e0) and s.center_lon + 0.05e0 / greatest(cos(radians(s.center_lat)), 0.05e0)"
Q["p13_label_hygiene"] = lambda q: "select conv_id, turn, role from conversations where role not like '\\_\\_%' escape '\\' and trim(role) <> '' and trim(text) <> ''" if not q.spark else "select conv_id, turn, role from conversations where not startswith(role, '__') and trim(role) <> '' and trim(text) <> ''"
_NAME = "concat('alert-v1__', detection_id, '__', scene_id, '__lat-', {f}latitude), '__lon-', {f}longitude), '__DARK_VESSEL.jpg')"
_ALERT = "^alert-v1__([A-Za-z0-9_-]+)__([A-Za-z0-9_-]+)__lat-(-?[0-9]+(?:[.][0-9]+)?)__lon-(-?[0-9]+(?:[.][0-9]+)?)__DARK_VESSEL[.]jpg$"
_alert = lambda q: f"select {_NAME.format(f=q.pick('format_string(\"%.6f\", ', 'format(chr(123) || chr(58) || chr(46) || chr(54) || chr(102) || chr(125), '))} as filename from contacts"
Q["p14_alert_parse"] = lambda q: f"select {q.group('filename', _ALERT, 1)} as detection_id, {q.group('filename', _ALERT, 2)} as scene_id, cast({q.group('filename', _ALERT, 3)} as double) as latitude, cast({q.group('filename', _ALERT, 4)} as double) as longitude from ({_alert(q)}) t"
Q["s15_alert_filename"] = _alert
Q["p17_sanitise"] = lambda q: "select c_custkey, case when c_acctbal = 0 then null else round(1 / c_acctbal, 9) end as inverse from customer"
Q["p18_qa_bits"] = lambda q: "select event_id, (event_id & 1) = 1 as clear, (event_id & 2) = 2 as water, (event_id & 4) = 4 as ice, (event_id & 8) = 8 as cloud, (event_id & 15) = 0 as other from events"
# --- aggregates
Q["a1_class_counts"] = lambda q: f"select classification, count(*) as n from ({targets(q)}) t group by classification"
Q["a2_funnel"] = lambda q: "select count(*) as candidates, sum(case when hull_len_m >= 6 then 1 else 0 end) as after_size, sum(case when physics_score >= 0.35e0 then 1 else 0 end) as after_physics, sum(case when wake_length_m > 0 then 1 else 0 end) as with_wake from contacts"
Q["a3_reasons"] = lambda q: f"select reason, count(*) as n from ({Q['j5_unobserved'](q)}) t group by reason"
Q["a4_scorecard"] = lambda q: f"select s.scene_id, coalesce(m.n, 0) as matched, coalesce(u.n, 0) as clear_water, case when coalesce(m.n, 0) + coalesce(u.n, 0) > 0 then round(coalesce(m.n, 0) * 1e0 / (coalesce(m.n, 0) + coalesce(u.n, 0)), 6) end as recall, round(s.water_pct / 100 * s.valid_pct / 100 * s.width * s.height * s.gsd_m * s.gsd_m / 1e6, 6) as searched_km2 from scenes s left join (select scene_id, count(*) as n from matches group by scene_id) m on m.scene_id = s.scene_id left join (select scene_id, count(*) as n from ({Q['j5_unobserved'](q)}) j where reason = 'CLEAR_WATER_NO_TARGET' group by scene_id) u on u.scene_id = s.scene_id"
Q["a5_precision"] = lambda q: f"select sum(case when verdict = 'vessel' then 1 else 0 end) as true_n, sum(case when verdict in ('not_vessel', 'structure') then 1 else 0 end) as false_n, round(sum(case when verdict = 'vessel' then 1e0 else 0e0 end) / nullif(sum(case when verdict <> 'unsure' then 1e0 else 0e0 end), 0), 6) as adjudicated_precision from ({Q['j16_verdicts'](q)}) t"
Q["a6_quantiles"] = lambda q: f"select scene_id, count(*) as n, {q.upper('wake_length_m', 0.5)} as med, {q.upper('wake_length_m', 0.9)} as p90, max(wake_length_m) as top from contacts group by scene_id"
Q["a7_within"] = lambda q: "select scene_id, round(100 * avg(case when dist * 1852 <= 200 then 1e0 else 0e0 end), 6) as within_200m from matches group by scene_id"
Q["a8_detection_scores"] = lambda q: f"select count(*) as matched, round(avg({q.angle('d.heading_deg', 'c.cog_deg')}), 6) as heading_mae, round({q.median(q.angle('d.heading_deg', 'c.cog_deg'))}, 6) as heading_median, round(avg(abs(d.hull_len_m - c.length_m) / c.length_m), 6) as length_mape from matches m join contacts d on d.detection_id = m.detection_id join catalog c on c.scene_id = m.scene_id and c.mmsi = m.mmsi"
Q["a9_rank_auc"] = lambda q: "select round((sum(g * (before + (n + 1) / 2e0)) - sum(g) * (sum(g) + 1) / 2e0) / (sum(g) * (sum(n) - sum(g))), 9) as auc from (select g, n, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as before from (select physics_score as score, count(*) as n, sum(case when contact_key % 3 = 0 then 1 else 0 end) as g from contacts group by physics_score) a) b"
Q["a10_robust_sigma"] = lambda q: f"select d.scene_id, round(1.4826e0 * {q.median('abs(d.peak_z - m.med)')}, 9) as sigma from contacts d join (select scene_id, {q.median('peak_z')} as med from contacts group by scene_id) m on m.scene_id = d.scene_id group by d.scene_id"
Q["a15_profile_costs"] = lambda q: f"select event_type as profile, {q.median('value')} as med, min(value) as low, max(value) as high, count(*) as n from events group by event_type"
Q["a16_orbit_summary"] = lambda q: f"select user_id, max(value) as peak, {q.argmax('event_type', q.struct('ts', 'event_id'))} as final_profile, count(distinct event_type) as profiles, sum(case when event_type <> before then 1 else 0 end) as transitions from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) t group by user_id"
Q["a17_soak_drift"] = lambda q: f"select round({q.median('case when k <= ' + q.idiv('n + 3', 4) + ' then value end')}, 6) as first_quarter, round({q.median('case when k > n - ' + q.idiv('n', 4) + ' then value end')}, 6) as last_quarter from (select value, k, (select count(*) from events) as n from (" + running("select ts, event_id, value from events", {"day": q.date("ts")}, "day", "ts, event_id") + ") t) u"
Q["a18_benchmark_stats"] = lambda q: "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd from events group by event_type"
Q["a19_label_counts"] = lambda q: "select role, case length(text) % 4 when 0 then 'vessel' when 1 then 'not_vessel' when 2 then 'structure' else 'unsure' end as verdict, count(*) as n from conversations group by 1, 2"
Q["a20_histogram_modes"] = lambda q: "with h as (select cast(floor(value) as int) as bin, count(*) as n from events group by 1), s as (select bin, n, avg(n) over (order by bin rows between 2 preceding and 2 following) as smooth from h), p as (select *, lag(smooth) over (order by bin) as before, lead(smooth) over (order by bin) as after, sum(n) over () as total from s) select bin, round(smooth, 6) as smooth from p where smooth > coalesce(before, 0) and smooth >= coalesce(after, 0) and smooth > 0.02e0 * total / 5"
Q["a21_percentiles"] = lambda q: "select event_type, " + ", ".join(f"round({q.quantile('value', p / 100)}, 6) as p{p}" for p in (5, 25, 50, 75, 95)) + ", max(value) as top, round(stddev_pop(value), 6) as sd from events group by event_type having count(*) >= 30"
Q["a27_survey_months"] = lambda q: "select month(ts) as m, count(*) as scenes, sum(case when value < 30 then 1 else 0 end) as clear from events group by 1"
Q["a28_probe_counts"] = lambda q: "select scene_id, count(*) as fixes, count(distinct mmsi) as broadcasters, sum(case when cast(mmsi as varchar(20)) like '316%' then 1 else 0 end) as flagged, sum(case when sog_knots >= 3 then 1 else 0 end) as under_way from fixes group by scene_id"
Q["a29_retention"] = lambda q: f"select cue, round(avg(pct), 6) as mean_pct, round({q.quantile('pct', 0.9)}, 6) as p90, max(pct) as top, round(100 * avg(case when pct = 0 then 1e0 else 0e0 end), 6) as clean from (select cue, scene_id, 100e0 * avg(case when physics_score > cue then 1e0 else 0e0 end) as pct from contacts cross join (select * from (values (0.4e0), (0.6e0), (0.8e0)) as v(cue)) c group by cue, scene_id) t group by cue"
Q["a30_strata_recall"] = lambda q: "select size_class, count(*) as n, round(avg(case when found then 1e0 else 0e0 end), 6) as recall, round(sum(case when found then 0e0 else 1e0 end) / (count(*) * 1.28e0 * 1.28e0), 6) as missed_per_km2 from (select " + _SIZE + " as size_class, physics_score > 0.6e0 as found from contacts) t group by size_class"
Q["a31_outcomes"] = lambda q: f"select case when crc % 3 = 0 then 'withheld' else 'honest' end as grp, classification, count(*) as n from (select classification, length(detection_id) + cast(substr(detection_id, 2) as int) as crc from ({targets(q)}) t) z group by 1, 2"
Q["a33_distinct"] = lambda q: "select scene_id, count(distinct mmsi) as vessels, count(distinct cog_deg) as courses from fixes group by scene_id"
Q["a34_sweep"] = lambda q: "select k, n, n - first_value(n) over (order by k) as delta from (select k, sum(case when physics_score >= k then 1 else 0 end) as n from contacts cross join (select * from (values (0.3e0), (0.5e0), (0.7e0), (0.9e0)) as v(k)) c group by k) t"
# --- windows, order, sets
Q["w1_sequential_ids"] = lambda q: "select detection_id, concat(scene_id, '_T', lpad(cast(row_number() over (partition by scene_id order by y, x, detection_id) as varchar(10)), 3, '0')) as track_id from contacts"
Q["w2_byte_budget"] = lambda q: "select l_orderkey, l_linenumber from (" + running("select l_orderkey, l_linenumber, l_discount, cast(floor(l_extendedprice) as bigint) as size from lineitem", {"level": "l_discount", "lot": q.idiv("l_orderkey", 65536)}, "level desc, lot", "l_orderkey, l_linenumber", "size") + ") t where 1024 + k <= 50000000"
Q["w3_latest_verdict"] = lambda q: f"select conv_id, {q.argmax('length(text) % 4', 'turn')} as verdict from conversations group by conv_id"
Q["w4_transitions"] = lambda q: "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) t where before is not null and before <> event_type"
Q["w6_moving_average"] = lambda q: "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following), 6) as smooth from events"
_KINDS = "select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end as kind from orders"
Q["w7_round_robin"] = lambda q: f"select o_orderkey, sent from (select o_orderkey, k as sent from ({running(f"select o_orderkey, kind, i, case when kind = 0 then {q.idiv('i', 3)} else i end as slot from (select o_orderkey, kind, k - 1 - case when kind = 1 then urgent else 0 end as i from ({running(_KINDS, {'queue': 'kind', 'lot': q.idiv('o_orderkey', 65536)}, 'queue, lot', 'o_orderkey')}) a cross join (select sum(case when kind = 0 then 1 else 0 end) as urgent from ({_KINDS}) u) b) c", {'stretch': q.idiv('slot', 65536)}, 'stretch', 'slot, kind, i')}) d) e"
Q["w8_transmit_time"] = lambda q: "select o_orderkey, round(k / 5242880000e0, 6) as seconds from (" + running("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders", {"lot": q.idiv("o_orderkey", 65536)}, "lot", "o_orderkey", "cents") + ") t"
Q["w10_stage_changes"] = lambda q: "select user_id, event_id, before as from_stage, event_type as stage from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) e where before is null or before <> event_type order by ts desc, event_id desc limit 100"
Q["l1_candidate_cap"] = candidate_cap()
Q["l2_target_order"] = lambda q: f"select detection_id, row_number() over (order by priority desc, detection_id) as place from ({targets(q)}) t"
Q["l4_argbest"] = lambda q: f"select scene_id, {q.argmax('detection_id', q.struct('wake_snr', 'detection_id'))} as strongest from contacts group by scene_id"
Q["l5_listing"] = lambda q: "select s_name, k as place from (" + running("select s_name, s_suppkey from supplier", {"start": "substr(lower(s_name), 1, 14)"}, "start", "lower(s_name), s_suppkey") + ") t"
Q["l6_newest"] = lambda q: "select event_id from events order by ts desc, event_id desc limit 100"
Q["l8_cell_dedupe"] = lambda q: f"select detection_id from (select detection_id, row_number() over (partition by scene_id, {q.idiv('x', 8)}, {q.idiv('y', 8)} order by contact_key) as k from contacts) t where k = 1"
Q["u1_features"] = lambda q: f"select detection_id as id, classification, priority from ({targets(q)}) t union all select cast(mmsi as varchar(20)), 'AIS_NOT_OBSERVED', cast(null as double) from ({Q['j5_unobserved'](q)}) u where reason = 'CLEAR_WATER_NO_TARGET'"
Q["u2_scene_report"] = lambda q: "select scene_id, 'screened' as state from scenes where valid_pct >= 75 union all select scene_id, 'rejected' from scenes where valid_pct < 75"
Q["u3_merge_labels"] = lambda q: "select doc_id, cast(quality as bigint) as verdict, 'synced' as origin from labels union all select d.doc_id, d.n_chars % 2, 'local' from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"
Q["u4_gained"] = lambda q: "select mmsi from fixes except select mmsi from matches"
Q["u5_overlap"] = lambda q: "select doc_id from labels intersect select doc_id from documents where n_chars > 1000"
Q["u6_scene_union"] = lambda q: "select scene_id from contacts union select scene_id from catalog"
Q["u7_split"] = lambda q: "select scene_id, case when scene_key % 4 = 0 then 'holdout' else 'train' end as part from scenes"
# --- scalar functions
Q["f1_haversine_nm"] = lambda q: f"select d.detection_id, round({q.haversine_nm('d.latitude', 'd.longitude', 's.center_lat', 's.center_lon')}, 6) as nm from contacts d join scenes s on s.scene_id = d.scene_id"
Q["f2_haversine_m"] = lambda q: f"select d.detection_id, round({q.haversine_m('d.latitude', 'd.longitude', 's.center_lat', 's.center_lon')}, 3) as m from contacts d join scenes s on s.scene_id = d.scene_id"
Q["f3_dead_reckoning"] = lambda q: "select scene_id, mmsi, round(plat, 6) as plat, round(plon, 6) as plon from catalog"
Q["f4_angular_difference"] = lambda q: f"select detection_id, {q.angle('heading_deg', 'wake_snr * 17')} as diff, least({q.angle('heading_deg', 'wake_snr * 17')}, 180e0 - {q.angle('heading_deg', 'wake_snr * 17')}) as folded from contacts"
Q["f6_kelvin_speed"] = lambda q: "select detection_id, round(sqrt(9.80665e0 * wake_length_m / (2 * pi())) * 1.943844e0, 6) as knots from contacts"
Q["f7_pixel_to_lonlat"] = lambda q: "select d.detection_id, round(s.center_lon + (d.x / 2047e0 - 0.5e0) * s.width * s.gsd_m / (111320e0 * greatest(cos(radians(s.center_lat)), 1e-6)), 9) as lon, round(s.center_lat + (0.5e0 - d.y / 2047e0) * s.height * s.gsd_m / 111320e0, 9) as lat from contacts d join scenes s on s.scene_id = d.scene_id"
Q["f8_lonlat_to_pixel"] = lambda q: f"select c.scene_id, c.mmsi, round({_PX}, 4) as px, round({_PY}, 4) as py from catalog c join scenes s on s.scene_id = c.scene_id"
Q["f10_true_bearing"] = lambda q: f"select detection_id, round({q.pmod('degrees(atan2(x - 1024e0, 1024e0 - y))', '360e0')}, 6) as bearing from contacts"
Q["f11_offset"] = lambda q: "select detection_id, round(latitude + wake_length_m / 111320e0, 9) as lat, round(longitude + hull_len_m / (111320e0 * greatest(cos(radians(latitude)), 1e-6)), 9) as lon from contacts"
Q["f14_fix_age"] = lambda q: "select scene_id, mmsi, round(greatest(-3e0, least(3e0, age_h)), 6) as age_h from nearest_fix"
Q["f15_physics_score"] = lambda q: "select detection_id, round(case when contact_key % 17 = 0 then 0.55e0 when hull_wid_m > 65 or hull_len_m > 460 or hull_len_m < 6 or (hull_len_m >= 30 and hull_len_m / greatest(hull_wid_m, 1e-3) < 1.5e0 and wake_length_m = 0) then least(score, 0.30e0) else score end, 9) as score from (select *, 0.35e0 * least(greatest((peak_z - 5) / 15e0, 0e0), 1e0) + 0.25e0 * case when hull_len_m < 30 then 0.5e0 else least(greatest((hull_len_m / greatest(hull_wid_m, 1e-3) - 1.2e0) / 1.8e0, 0e0), 1e0) end + 0.30e0 * case when wake_length_m > 0 then least(wake_snr / 10e0, 1e0) else 0e0 end as score from contacts) t"
Q["f16_size_class"] = lambda q: f"select detection_id, {_SIZE} as size_class from contacts"
Q["f17_confidence"] = lambda q: "select detection_id, round(0.5e0 * physics_score + 0.5e0 * wake_snr / 20e0, 3) as confidence from contacts"
Q["f18_match_problems"] = lambda q: f"select detection_id, off_track, bad_course, bad_speed from ({problems(q)}) t where mmsi is not null"
Q["f21_arctic"] = lambda q: f"select t.detection_id, case when t.mmsi is not null then 'SHIP' when d.wake_length_m = 0 and d.neighbours >= 3 and d.neighbours / 0.4096e0 >= 7 then 'ICEBERG' else 'UNCERTAIN' end as arctic from ({targets(q)}) t join contacts d on d.detection_id = t.detection_id join scenes s on s.scene_id = t.scene_id where s.ice_pct >= 2 and t.classification <> 'KNOWN_STRUCTURE'"
Q["f24_cep"] = lambda q: "select detection_id, round(wake_snr / sqrt(2 * ln(2e0)), 9) as sigma, round(0.589e0 * (wake_snr + peak_z), 9) as cep_elliptical, round(wake_snr * sqrt(-2 * ln(1 - 0.9e0)), 9) as r90 from contacts"
Q["f26_expected"] = lambda q: "select scene_id, round(count(*) / 419.4304e0 * pi() * 2.5e0 * 2.5e0, 9) as expected from contacts group by scene_id"
Q["f27_staleness"] = lambda q: "select knots, minutes, round(knots * 0.514444e0 * minutes * 60, 6) as metres from (values (5e0), (10e0), (15e0), (25e0)) as a(knots) cross join (values (5e0), (15e0), (30e0), (60e0)) as b(minutes)"
Q["f29_orbit_phase"] = lambda q: f"select event_id, {q.pmod('value * 60 / 5676e0', '1e0')} >= 0.35e0 as sunlit, round((case when {q.pmod('value * 60 / 5676e0', '1e0')} < 0.35e0 then 0.35e0 else 1e0 end - {q.pmod('value * 60 / 5676e0', '1e0')}) * 5676, 6) as to_terminator from events"
Q["f32_crop_padding"] = lambda q: "select detection_id, least(160, greatest(64, cast(ceil(1.5e0 * hull_len_m / 10) as int))) as pad from contacts"
Q["f34_temperature"] = lambda q: "select event_id, round((event_id % 65536) * 0.00341802e0 + 149e0 - 273.15e0, 4) as celsius from events"
Q["f37_tangent_plane"] = lambda q: "select d.detection_id, round((d.longitude - s.center_lon) * 111195e0 * cos(radians(s.center_lat)), 6) as east, round((d.latitude - s.center_lat) * 111195e0, 6) as north from contacts d join scenes s on s.scene_id = d.scene_id"
Q["g2_hottest_zone"] = lambda q: "select max(case when event_type in ('click', 'view') and value - 40 between -50 and 150 then value - 40 end) as celsius from events"
Q["g6_last_cost"] = lambda q: f"select event_type as stage, {q.argmax('value', q.struct('ts', 'event_id'))} as seconds from events group by event_type"
Q["r8_within_swath"] = lambda q: "select z, round(0.722e0 * (1 - exp(-z * z / 2)) + 0.278e0 * (1 - exp(-z * z / (2 * 6.8e0 * 6.8e0))), 9) as p from (values (0.5e0), (1e0), (2e0), (4e0), (8e0)) as v(z)"
Q["d9_spoofed_course"] = lambda q: f"select mmsi, event_id, case when event_id % 5 = 0 then {q.pmod('cog_deg + 105', '360e0')} else cog_deg end as cog_deg, case when event_id % 7 = 0 then 0e0 else sog_knots end as sog_knots from fixes"
Q["d10_dn"] = lambda q: "select detection_id, cast(floor(least(65535e0, greatest(1e0, physics_score * 10000 + 0.5e0))) as int) as dn from contacts"
Q["d15_percent"] = lambda q: "select scene_id, round(100e0 * sum(case when wake_length_m > 400 then 1 else 0 end) / nullif(sum(case when wake_length_m > 0 then 1 else 0 end), 0), 6) as pct from contacts group by scene_id"
Q["y7_grid_search"] = lambda q: f"select {q.argmax('a', q.struct('got', '-a', '-b'))} as a, {q.argmax('b', q.struct('got', '-a', '-b'))} as b, max(got) as got from (select a, b, sum(case when ice and neighbours >= a and peak_z >= b then 1 else 0 end) as got, sum(case when not ice and neighbours >= a and peak_z >= b then 1e0 else 0e0 end) / sum(case when ice then 0e0 else 1e0 end) as lost from (select neighbours, peak_z, contact_key % 4 = 0 as ice from contacts) c cross join (values (1), (3), (5), (7), (8)) as g(a) cross join (values (0), (8), (16), (24), (28)) as h(b) group by a, b) t where lost <= 0.02e0"
Q["y8_threshold_sweep"] = lambda q: "select k, sum(case when neighbours >= k and wake_length_m = 0 then 1 else 0 end) as demoted, sum(case when neighbours >= k and wake_length_m > 0 then 1 else 0 end) as kept from contacts cross join (values (1), (2), (3), (4), (5)) as v(k) group by k"
Q["y9_grouping_sets"] = lambda q: "select target_type, scene_id, count(*) as n, round(avg(case when physics_score >= 0.8e0 then 1e0 else 0e0 end), 6) as pass_fraction from contacts group by grouping sets ((), (target_type), (scene_id))"
Q["y16_scene_acceptance"] = lambda q: "select user_id % 25 as aoi, event_id from (select event_id, user_id, row_number() over (partition by user_id % 25 order by coalesce(value, 100), event_id) as k from events where value <= 60) t where k = 1"
Q["y20_cue_tables"] = lambda q: "select knots, offnadir, round(500 * tan(radians(offnadir)) / (knots * 1.852e0) * 60, 6) as minutes from (values (5e0), (10e0), (15e0)) as a(knots) cross join (values (5e0), (15e0), (30e0)) as b(offnadir)"
Q["t6_broadcast_density"] = lambda q: f"select {q.pick('cast(window.start as date)', 'cast(ts as date)')} as day, count(*) as n from events group by " + q.pick("window(cast(ts as timestamp), '1 day')", "1")
Q["f35_dates"] = lambda q: "select o_orderkey, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as ymd from orders"
Q["f36_sha256"] = lambda q: f"select doc_id, {q.pick('sha2(text, 256)', 'sha256(text)')} as digest from documents"
