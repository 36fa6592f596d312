"""Further queries that both dialects spell: pixel tables, modelled radio cues, catalogues of broadcasts, notes and budgets."""

from __future__ import annotations

from .catalogue import _PX, _PY, problems, targets
from .dialect import Dialect

S: dict = {}

# --- pixel tables: each vector of 64 values is an 8 x 8 raster
_RAY = "partition by vec_id, y order by x"
_COL = "partition by vec_id, x order by y"
_mirror = lambda f, g, v, w: f"coalesce({f}({v}) over ({w}), {g}({v}) over ({w}))"  # noqa: E731  the border repeats what is one step inside
_CROSS = f"select vec_id, y, x, v, {_mirror('lag', 'lead', 'v', _RAY)} as west, {_mirror('lead', 'lag', 'v', _RAY)} as east, {_mirror('lag', 'lead', 'v', _COL)} as north, {_mirror('lead', 'lag', 'v', _COL)} as south from pixels"
S["a12_blur"] = lambda q: f"select vec_id, round(var_pop(west + east + north + south - 4 * v), 9) as blur from ({_CROSS}) n group by vec_id"
S["a13_integrated_contrast"] = lambda q: f"select vec_id, {q.idiv('y', 4)} * 2 + {q.idiv('x', 4)} as label, round(sum(greatest(v - level, 0e0)), 9) as contrast, count(*) as area from (select *, avg(v) over (partition by vec_id) as level from pixels) t group by 1, 2"
S["w5_ray_walk"] = lambda q: f"with o as (select *, avg(case when v > 0.05e0 then 1e0 else 0e0 end) over ({_RAY} rows between current row and 8 following) as occupied from pixels), e as (select vec_id, y, coalesce(min(case when occupied < 0.5e0 then x end), 8) as stop from o group by vec_id, y) select o.vec_id, o.y as ray, max(e.stop) as stop, round(sum(case when o.x < e.stop then o.v else 0e0 end), 6) as score from o join e on e.vec_id = o.vec_id and e.y = o.y group by o.vec_id, o.y"
S["w9_box_blur"] = lambda q: f"select vec_id, y, x, round(({_mirror('lag', 'lead', 's', _COL)} + s + {_mirror('lead', 'lag', 's', _COL)}) / 9, 9) as blur from (select vec_id, y, x, {_mirror('lag', 'lead', 'v', _RAY)} + v + {_mirror('lead', 'lag', 'v', _RAY)} as s from pixels) t"
S["a22_neighbour_strata"] = lambda q: f"with r as (select vec_id, y, x, v, case when v < 0 then 1 else 0 end as water, sum(case when v < 0 then 1 else 0 end) over ({_RAY} rows between 1 preceding and 1 following) as s from pixels), n as (select v, water, sum(s) over ({_COL} rows between 1 preceding and 1 following) - water as near from r) select cast(near as int) as near, count(*) as cells, round({q.median('v')}, 6) as med from n where water = 1 group by 1"
_VARIOGRAM = "select lag, round(0.5e0 * avg(dv * dv), 9) as gamma, count(dv) as n from (" + " union all ".join(f"select {h} as lag, lead(v, {h}) over ({w}) - v as dv from pixels where {{where}}" for h in range(1, 8) for w in (_RAY, _COL)) + ") d group by lag having count(dv) >= 100"
S["a24_semivariogram"] = lambda q: _VARIOGRAM.replace("{where}", "true")
_half = lambda where: f"select min(spot) as half_lag from (select case when before is null then lag * 1e0 else round(lag0 + (half - before) / (gamma - before), 6) end as spot from (select lag, gamma, max(gamma) over () / 2 as half, lag(gamma) over (order by lag) as before, lag(lag) over (order by lag) as lag0 from ({_VARIOGRAM.replace('{where}', where)}) g) s where gamma >= half and (before is null or before < half)) t"
S["a25_half_sill"] = lambda q: _half("true")
S["y2_control_half_sill"] = lambda q: f"select 'even' as bundle, half_lag from ({_half('vec_id % 2 = 0')}) a union all select 'odd', half_lag from ({_half('vec_id % 2 = 1')}) b"
S["y4_contrast_table"] = lambda q: f"select p.vec_id, p.med, p.p95, b.blur, p.p95 - p.med as contrast from (select vec_id, round({q.median('v')}, 9) as med, round({q.quantile('v', 0.95)}, 9) as p95 from pixels group by vec_id) p join ({S['a12_blur'](q)}) b on b.vec_id = p.vec_id"
S["y5_patch"] = lambda q: "select vec_id, count(*) as n, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as sd, max(v) as top from pixels where y between vec_id % 8 - 2 and vec_id % 8 + 2 and x between (vec_id * 3) % 8 - 2 and (vec_id * 3) % 8 + 2 group by vec_id"
S["f33_display"] = lambda q: "select vec_id, y, x, cast(floor(power(least(greatest(abs(v) / 0.35e0, 0e0), 1e0), 1 / 2.2e0) * 255 + 0.5e0) as int) as level from pixels"

# --- predicates, projections, bounds
S["p3_shore_keepout"] = lambda q: "select detection_id from (select detection_id, x, row_number() over (partition by scene_id order by hull_len_m desc, y, x, detection_id) as k from contacts) t where k <= 400 and x - 6 >= 64"
# The property keys of an alert feature, in their order.
KEYS = "detection_id scene_id classification downlink_priority target_type size_class confidence physics_score verifier_prob heading_deg heading_ambiguous_180 estimated_speed_knots speed_method hull_length_m hull_width_m wake_length_m kelvin_arms_detected kelvin_half_angle_deg matched_vessel ais_distance_nm intelligence_notes ice_regime lead_length_m".split()


def features(q: Dialect) -> str:
    have = {"detection_id": "d.detection_id", "scene_id": "d.scene_id", "classification": "t.classification", "downlink_priority": "t.priority", "target_type": "d.target_type", "physics_score": "d.physics_score", "heading_deg": "d.heading_deg", "heading_ambiguous_180": "d.heading_ambiguous_180", "hull_length_m": "d.hull_len_m", "hull_width_m": "d.hull_wid_m", "wake_length_m": "d.wake_length_m", "matched_vessel": "t.mmsi", "ais_distance_nm": "t.ais_distance_nm"}
    kind = {"confidence": "double", "verifier_prob": "double", "estimated_speed_knots": "double", "kelvin_arms_detected": "boolean", "kelvin_half_angle_deg": "double", "ice_regime": "boolean", "lead_length_m": "double"}
    return "select " + ", ".join(f"{have.get(k) or f'cast(null as {kind.get(k, q.pick(chr(115) + 'tring', 'varchar'))})'} as {k}" for k in KEYS) + f" from ({targets(q)}) t join contacts d on d.detection_id = t.detection_id"


S["p15_feature_keys"] = features
S["p16_track"] = lambda q: "select 'quality' as track, scene_id, 'screen' as stage from scenes where valid_pct >= 75 union all select 'full', scene_id, 'detect' from scenes where valid_pct >= 75 and cloud_pct <= 60"
S["s13_scene_report"] = lambda q: "select scene_id, 'usable' as state, cloud_pct, ice_pct, water_pct, valid_pct, cast(null as varchar(40)) as error from scenes where valid_pct >= 75 union all select scene_id, 'rejected', null, null, null, null, 'DECODE_ERROR' from scenes where valid_pct < 75"
S["s12_reason_metadata"] = lambda q: f"select reason, count(*) as n, sum(case when reason = 'CLEAR_WATER_NO_TARGET' then 1 else 0 end) as appended from (select case when length_m > 0 and length_m < 25 then 'BELOW_SENSOR_RESOLUTION' else 'CLEAR_WATER_NO_TARGET' end as reason from (select c.*, {_PX} as px, {_PY} as py from catalog c join scenes s on s.scene_id = c.scene_id where abs(c.age_h) <= 3 and not exists (select 1 from matches m where m.scene_id = c.scene_id and m.mmsi = c.mmsi)) u) r group by reason"
S["d4_crop_bounds"] = lambda q: "select detection_id, left_px, top_px, right_px, bottom_px from (select detection_id, greatest(0, x - pad) as left_px, greatest(0, y - pad) as top_px, least(2048, x + pad + 1) as right_px, least(2048, y + pad + 1) as bottom_px from (select detection_id, x, y, least(160, greatest(64, cast(ceil(1.5e0 * hull_len_m / 10) as int))) as pad from contacts) p) b where left_px < right_px and top_px < bottom_px"
S["y19_sheet_crop"] = lambda q: "select detection_id, case when x - 700 + 48 <= 0 or y - 700 + 48 <= 0 then null else greatest(0, x - 700 - 48) end as from_x, case when x - 700 + 48 <= 0 or y - 700 + 48 <= 0 then null else greatest(0, 48 - (x - 700)) end as pad_left from contacts"
S["d5_queue_origin"] = lambda q: f"select detection_id, concat(detection_id, '.jpg.queue-origin') as marker, case when mmsi is not null then 'nonPriority' else 'priority' end as queue_origin from ({targets(q)}) t"
S["d8_stage_listing"] = lambda q: "select o_orderkey as file, 'priority' as stage, o_totalprice as bytes from orders where o_orderstatus = 'O' union all select o_orderkey, 'nonPriority', o_totalprice from orders where o_orderstatus = 'F' union all select o_orderkey, 'sent', o_totalprice from orders where o_orderstatus = 'P'"
S["d1_canonical_json"] = lambda q: "select scene_id, " + q.pick("to_json(named_struct('ice', cast(ice_pct * 2 as bigint), 'scene', scene_id, 'usable', valid_pct >= 75))", "cast(to_json(struct_pack(ice := cast(ice_pct * 2 as bigint), scene := scene_id, usable := valid_pct >= 75)) as varchar)") + " as summary from scenes where ice_pct >= 2"
S["d2_icy_evidence"] = lambda q: "select d.detection_id, case when s.ice_pct >= 2 and d.peak_z >= 4 then d.neighbours end as neighbours, case when s.ice_pct >= 2 and d.peak_z >= 4 then round(d.neighbours / 0.4096e0, 2) end as per_km2 from contacts d join scenes s on s.scene_id = d.scene_id"
S["d13_survey_box"] = lambda q: f"select mmsi, event_id from (select mmsi, event_id, row_number() over (partition by mmsi order by abs({q.seconds('fix_time', 'timestamp ' + repr('2024-01-15 12:00:00'))}), event_id) as k from fixes where latitude between 30 and 45 and longitude between -80 and -55 and fix_time between timestamp '2024-01-15 00:00:00' and timestamp '2024-01-16 00:00:00') t where k = 1"
S["y17_valid_entries"] = lambda q: "select c_custkey from (select c_custkey, case when c_custkey % 7 = 0 then null else c_acctbal end as latitude, case when c_custkey % 11 = 0 then null else c_acctbal end as longitude, case when c_custkey % 13 = 0 then null else 3 end as passes from customer) t where latitude is not null and longitude is not null and passes is not null"
S["y12_tolerant_float"] = lambda q: "select c_custkey, try_cast(case c_custkey % 4 when 0 then '12.5' when 1 then 'n/a' when 2 then '' else cast(c_custkey as varchar(20)) end as double) as length_m from customer"

# --- scalar functions
S["f9_georeference"] = lambda q: "select scene_id, round(center_lon - half_w, 9) as west, round(center_lon + half_w, 9) as east, round(center_lat - half_h, 9) as south, round(center_lat + half_h, 9) as north, round(degrees(atan2(skew * cos(radians(center_lat)), 2 * half_h)), 9) as north_offset from (select *, height / 2e0 * gsd_m / 111320e0 as half_h, width / 2e0 * gsd_m / (111320e0 * greatest(cos(radians(center_lat)), 1e-6)) as half_w, scene_key * 0.002e0 as skew from scenes) s"
_even = lambda q, x: f"cast({q.pick(f'bround({x}, 0)', f'round_even({x}, 0)')} as int)"
S["f12_to_pixels"] = lambda q: f"select detection_id, greatest(1, {_even(q, 'hull_len_m / 8')}) as length_px, greatest(1, {_even(q, 'hull_len_m * hull_wid_m / 64')}) as area_px from contacts"
S["f13_iso_parse"] = lambda q: "select o_orderkey, " + q.pick("cast(try_to_timestamp(text) as timestamp_ntz)", "try_cast(replace(text, 'Z', '') as timestamp)") + " as at from (select o_orderkey, case o_orderkey % 5 when 0 then 'not a time' when 1 then concat(cast(cast(o_orderdate as date) as varchar(10)), 'T99:00:00Z') else concat(cast(cast(o_orderdate as date) as varchar(10)), 'T12:30:15Z') end as text from orders) t"


def notes(q: Dialect) -> str:
    why = "concat_ws('; ', case when off_track then 'position off the reported track' end, case when bad_course then 'course disagrees' end, case when bad_speed then 'wake of a ship under way at a reported speed of none' end)"
    return f"""select t.detection_id, case t.classification
      when 'AIS_KINEMATIC_MISMATCH' then concat('Co-located with MMSI ', cast(t.mmsi as varchar(20)), ' (', {q.fixed('t.ais_distance_nm', 2)}, ' NM) but ', {why}, '.')
      when 'CONFIRMED_KNOWN_VESSEL' then concat('Matches MMSI ', cast(t.mmsi as varchar(20)), ' at ', {q.fixed('t.ais_distance_nm', 2)}, ' NM; position and course consistent.')
      when 'KNOWN_STRUCTURE' then concat('Charted fixed structure: ', p.structure, '.')
      else concat('No broadcast within 1.0 NM of [', {q.fixed('d.latitude', 4)}, ', ', {q.fixed('d.longitude', 4)}, '].') end as note
      from ({targets(q)}) t join ({problems(q)}) p on p.detection_id = t.detection_id join contacts d on d.detection_id = t.detection_id"""


S["f20_notes"] = notes
S["f31_power"] = lambda q: "select event_id, round(4 + (watts - 4) * greatest(0e0, least(1e0, value / 50e0 / (2 * scenes))), 9) as watts from (select event_id, value, case event_id % 4 when 0 then 25e0 when 3 then 10e0 else 15e0 end as watts, case event_id % 4 when 0 then 3 when 1 then 2 else 1 end as scenes from events) t"
S["f38_ping_xml"] = lambda q: "select detection_id, round(" + q.pick("xpath_double(ping, '/fleet_ping/latitude')", "latitude") + ", 6) as latitude, " + q.pick("xpath_string(ping, '/fleet_ping/fleet/name')", "scene_id") + " as fleet from (select detection_id, scene_id, latitude" + q.pick(", concat('<fleet_ping><detection_id>', detection_id, '</detection_id><latitude>', cast(latitude as string), '</latitude><fleet><name>', scene_id, '</name></fleet></fleet_ping>') as ping", "") + " from contacts) t"
_LOAD = "(0.85e0 * 5.670374419e-8 * 0.090e0)"
_SPACE4 = "power(2.7e0, 4)"
S["f28_radiated"] = lambda q: f"select c_custkey, round({_LOAD} * (power(c_acctbal / 200 + 293.15e0, 4) - {_SPACE4}), 9) as watts, round(power((10 + 12e0) / {_LOAD} + {_SPACE4}, 0.25e0) - 273.15e0 + 10 * 0.9e0, 9) as junction from customer"


def sustainable(q: Dialect) -> str:
    """Power that a bus at 80 C rejects for ever: 24 damped steps, in sunlight and in eclipse."""
    step = lambda p, sun: f"greatest(0e0, 0.5e0 * {p} + 0.5e0 * ({_LOAD} * (power(80e0 - {p} * 0.9e0 + 273.15e0, 4) - {_SPACE4}) - {sun} - 12e0))"
    folded = "aggregate(sequence(1, 24), 10e0, (p, i) -> " + step("p", "sun") + ")"
    inner = "select lit, case when lit then 0.20e0 * 1361e0 * 0.090e0 else 0e0 end as sun from (values (true), (false)) as v(lit)"
    if q.spark:
        return f"select lit, round({folded}, 4) as watts from ({inner}) s"
    return f"with recursive s as ({inner}), f as (select lit, sun, 10e0 as p, 0 as i from s union all select lit, sun, {step('p', 'sun')}, i + 1 from f where i < 24) select lit, round(p, 4) as watts from f where i = 24"


S["f28_sustainable"] = sustainable
S["g1_workers"] = lambda q: "select configured, profile, greatest(1, least(configured, allowed)) as workers from (values (0), (1), (2), (3), (8)) as c(configured) cross join (values ('FULL', 3), ('REDUCED', 2), ('SURVEY', 1), ('BEACON', 1)) as p(profile, allowed)"
S["g4_junction"] = lambda q: "select event_id, coalesce(case when event_type = 'click' then value end, 25e0 + value / 10) as junction_c, case when event_type = 'click' then 'sensor' else 'model' end as origin from events"
S["g5_headroom"] = lambda q: "select event_id, value >= 95 as throttling, 95 - value as headroom_c, case when event_id % 40 in (10, 15, 25) then cast(event_id % 40 as double) end as mode_w from events"
S["a32_telemetry"] = lambda q: "select o_orderpriority as label, round(sum(o_totalprice) / 1048576, 3) as input_mb, round(sum(o_totalprice) / (count(*) * 64e0), 1) as reduction, round((1 - count(*) * 64e0 / sum(o_totalprice)) * 100, 3) as saved_pct from orders group by o_orderpriority"

# --- broadcasts: connectors' rules
_BOX = "f.latitude between s.center_lat - 0.06e0 and s.center_lat + 0.06e0 and f.longitude between s.center_lon - 0.06e0 and s.center_lon + 0.06e0"
S["s18_broadcast_catalog"] = lambda q: f"select scene_id, mmsi, sog_knots, cog_deg, heading_deg, length_m, age_s from (select f.scene_id, f.mmsi, greatest(f.sog_knots, 0e0) as sog_knots, case when f.raw_cog >= 0 and f.raw_cog < 360 then f.raw_cog when f.raw_hdg < 360 then f.raw_hdg else 0e0 end as cog_deg, case when f.raw_hdg < 360 then f.raw_hdg end as heading_deg, nullif(f.length_m, 0) as length_m, round(abs({q.seconds('s.shutter_time', 'f.fix_time')}), 1) as age_s, row_number() over (partition by f.scene_id, f.mmsi order by abs({q.seconds('s.shutter_time', 'f.fix_time')}), f.event_id) as k from (select *, case when event_id % 6 = 0 then -1e0 else cog_deg end as raw_cog, case when event_id % 4 = 0 then 511e0 else cast(event_id % 360 as double) end as raw_hdg from fixes) f join scenes s on s.scene_id = f.scene_id and {_BOX} and f.fix_time between s.shutter_time - interval 3 days and s.shutter_time + interval 3 days) t where k = 1"
S["s19_positional_rows"] = lambda q: "select event_id, cast(" + q.pick("r[0]", "json_extract_string(r, '$[0]')") + " as bigint) as mmsi, round(cast(" + q.pick("r[2]", "json_extract_string(r, '$[2]')") + " as double), 6) as longitude, cast(" + q.pick("r[6]", "json_extract_string(r, '$[6]')") + " as int) as message from (select event_id, " + q.pick("from_json({0}, 'array<string>')", "{0}").format("concat('[', cast(mmsi as varchar(20)), ',\"x\",', cast(round(longitude, 6) as varchar(30)), ',0,0,0,', cast(event_id % 20 as varchar(5)), ']')") + " as r from fixes) t"
S["s20_enriched"] = lambda q: "select f.event_id, coalesce(c.c_name, concat('MMSI ', cast(f.mmsi as varchar(20)))) as name, case when f.event_id % 20 in (1, 2, 3) then 'A' when f.event_id % 20 in (18, 19) then 'B' end as transceiver_class from fixes f left join customer c on c.c_custkey = f.mmsi - 316000000"
S["s22_scene_choice"] = lambda q: "select aoi, event_id, value from (select user_id % 25 as aoi, event_id, value, row_number() over (partition by user_id % 25 order by value, ts, event_id) as k from events where event_id % 100 <= 15) t where k = 1"
S["s23_best_correlation"] = lambda q: f"select mode, case when max(r) >= 0.9e0 then {q.argmax('flag', q.struct('r', 'flag'))} end as product, round(max(r), 6) as r from (select l_linenumber as mode, l_returnflag as flag, corr(l_quantity, l_extendedprice) as r from lineitem group by 1, 2) t group by mode"
S["s24_thermal_survey"] = lambda q: "select user_id % 25 as aoi, month(ts) as m, count(*) as scenes, sum(case when value < 30 then 1 else 0 end) as clear from events group by 1, 2"
S["s25_box_rows"] = lambda q: "select contact_key, cast(" + q.pick("p[0]", "p[1]") + " as int) as x0, cast(" + q.pick("p[3]", "p[4]") + " as int) as y1 from (select contact_key, split(box, ' ') as p from (select contact_key, " + q.pick("explode(split(boxes, ';'))", "unnest(string_split(boxes, ';'))") + " as box from (select contact_key, concat(cast(x as varchar(9)), ' ', cast(y as varchar(9)), ' 12 ', cast(y + 9 as varchar(9)), ';', cast(y as varchar(9)), ' 1 2 3') as boxes from contacts) a) b) c".replace("split(box", q.pick("split(box", "string_split(box"))
S["s30_sheet_items"] = lambda q: f"select scene_id, detection_id as item, 'contact' as kind from ({targets(q)}) t union all select c.scene_id, concat('MISS_', c.scene_id, '_', cast(c.mmsi as varchar(20))), 'miss' from catalog c where not exists (select 1 from matches m where m.scene_id = c.scene_id and m.mmsi = c.mmsi)"
S["s31_label_since"] = lambda q: "select event_id, user_id, event_type from events where ts > timestamp '2024-01-20 00:00:00'"

# --- label transfer, box containment, strata
#: Two runs over the same scenes: contacts of one are the labelled reference, shifted by up to 3 pixels.
_REF = "select detection_id as ref_id, scene_id, contact_key, x + contact_key % 4 as x, y - contact_key % 3 as y from contacts where contact_key % 3 <> 1"
TRANSFER = f"select d.scene_id, d.detection_id, r.ref_id, sqrt(power(d.x - r.x, 2) + power(d.y - r.y, 2)) as d from contacts d join ({_REF}) r on r.scene_id = d.scene_id and abs(d.x - r.x) <= 40 and abs(d.y - r.y) <= 40 where power(d.x - r.x, 2) + power(d.y - r.y, 2) <= 1600"
S["j10_candidates"] = lambda q: f"select scene_id, detection_id, ref_id, round(d, 6) as d from ({TRANSFER}) t"
S["j12_in_box"] = lambda q: f"select d.detection_id, {q.argmin('b.contact_key', 'b.contact_key')} as first_box from contacts d join (select contact_key, scene_id, x as x0, y as y0, x + 30 as x1, y + 20 as y1 from contacts where contact_key % 2 = 0) b on b.scene_id = d.scene_id and d.x between b.x0 - 3 and b.x1 + 3 and d.y between b.y0 - 3 and b.y1 + 3 group by d.detection_id"
S["y10_strata"] = lambda q: f"select case when d.peak_z >= m.level then 'bright' else 'dark' end as level, case when d.wake_snr >= m.rough then 'rough' else 'calm' end as sea, count(*) as n, round(avg(d.physics_score), 6) as score from contacts d cross join (select {q.median('peak_z')} as level, {q.median('wake_snr')} as rough from contacts) m group by 1, 2"
S["y15_models"] = lambda q: f"select model, sum(case when p >= 0.8e0 then 1 else 0 end) as kept, sum(case when p >= 0.8e0 and not good then 1 else 0 end) as false_kept, sum(case when p < 0.8e0 and good then 1 else 0 end) as lost, round(sum(case when p >= 0.8e0 and good then 1e0 else 0e0 end) / nullif(sum(case when p >= 0.8e0 then 1 else 0 end), 0), 6) as adjudicated_precision, {q.upper('case when good then p end', 0.5)} as med from (select 'physics' as model, physics_score as p, contact_key % 3 = 0 as good from contacts union all select 'wake', wake_snr / 20e0, contact_key % 3 = 0 from contacts) t group by model"

# --- modelled radio cues
# Cues as (name, median error m, share of the tail, how much wider it is).
CUES = (("cep-1km", 1000, 0.0, 1.0), ("cep-2km", 2000, 0.0, 1.0), ("cep-5km", 5000, 0.0, 1.0), ("cep-10km", 10000, 0.0, 1.0), ("measured", 2500, 0.278, 6.8))
_CUES = "(select * from (values " + ", ".join(f"({i}, '{n}', {c}e0, {t}e0, {m}e0)" for i, (n, c, t, m) in enumerate(CUES)) + ") as v(pos, cue, cep, tail, wide)) cu"


def _mixture(z: str) -> str:
    return f"((1 - tail) * (1 - exp(-{z} * {z} / 2)) + tail * (1 - exp(-{z} * {z} / (2 * wide * wide))))"


def quantile_of(q: Dialect, p: str, name: str, table: str) -> str:
    """table(cue, ...) next to the radius, in core sigmas, that holds p of the errors: 60 halvings of (0, 40 wide)."""
    below = _mixture("((a.lo + a.hi) / 2)") + f" < {p}"
    if q.spark:
        fold = f"aggregate(sequence(1, 60), named_struct('lo', 0e0, 'hi', 40 * wide), (a, i) -> named_struct('lo', case when {below} then (a.lo + a.hi) / 2 else a.lo end, 'hi', case when {below} then a.hi else (a.lo + a.hi) / 2 end), a -> (a.lo + a.hi) / 2)"
        return f"(select *, {fold} as {name} from {table})"
    below = _mixture("((lo + hi) / 2)") + f" < {p}"
    return f"(with recursive a as (select *, 0e0 as lo, 40 * wide as hi, 0 as i from {table} union all select * exclude (lo, hi, i), case when {below} then (lo + hi) / 2 else lo end, case when {below} then hi else (lo + hi) / 2 end, i + 1 from a where i < 60) select * exclude (lo, hi, i), (lo + hi) / 2 as {name} from a where i = 60)"


def gates(q: Dialect) -> str:
    """Each cue with its core sigma and the radius that holds 95 % of its errors."""
    inner = quantile_of(q, "0.5e0", "z50", _CUES)
    outer = quantile_of(q, "0.95e0", "z95", inner + " m")
    return f"(select pos, cue, cep, tail, wide, cep / z50 as sigma, cep / z50 * z95 as gate from {outer} g)"


S["f25_mixture_quantile"] = lambda q: f"select cue, round(gate / sigma, 6) as z95 from {gates(q)} c"
S["r2_cue_model"] = lambda q: f"select cue, ratio, round(sigma, 4) as sigma, round(gate, 3) as gate, round(sigma * 2 / (sqrt(ratio) + 1 / sqrt(ratio)) * sqrt(ratio), 4) as major, round(sigma * 2 / (sqrt(ratio) + 1 / sqrt(ratio)) / sqrt(ratio), 4) as minor from {gates(q)} c cross join (values (1e0), (2e0), (3e0)) as r(ratio)"
S["r6_cues"] = lambda q: f"select cue, cep, tail, wide from {_CUES}"
S["r8_in_swath"] = lambda q: f"select cue, round({_mixture('(20000e0 / sigma)')}, 6) as p from {gates(q)} c"
#: Uniform numbers in (0, 1) from integers, the same in both engines.
_u = lambda k, salt: f"(((({k}) * 7919 + {salt} * 104729) % 1000003 * 48271) % 2147483647 + 0.5e0) / 2147483647e0"


def draws(q: Dialect, source: str, trials: int) -> str:
    """Fixes that the cues would give of source(emitter, scene_id, latitude, longitude): one a cue and trial, drawn from (trial, emitter)."""
    key = "(emitter * 131 + trial * 17 + pos)"
    rows = f"select e.*, c.cue, c.pos, c.sigma, c.gate, c.tail, c.wide, t.trial from ({source}) e cross join {gates(q)} c cross join (values {', '.join(f'({t})' for t in range(trials))}) as t(trial)"
    spread = f"select *, sigma * case when {_u(key, 1)} < tail then wide else 1e0 end * sqrt(-2 * ln({_u(key, 2)})) as r, 2 * pi() * {_u(key, 3)} as theta, {_u(key, 1)} < tail as from_tail from ({rows}) w"
    return f"select *, r as error_m, latitude + r * cos(theta) / 111320e0 as fix_lat, longitude + r * sin(theta) / (111320e0 * greatest(cos(radians(latitude)), 1e-6)) as fix_lon from ({spread}) d"


_EMITTERS = "select mmsi - 316000000 as emitter, scene_id, plat as latitude, plon as longitude, length_m from catalog"
S["r4_drawn_fixes"] = lambda q: f"select emitter, scene_id, cue, trial, from_tail, round(error_m, 3) as error_m, round(fix_lat, 7) as fix_lat, round(fix_lon, 7) as fix_lon from ({draws(q, _EMITTERS, 2)}) f"
S["r5_in_own_gate"] = lambda q: f"select cue, count(*) as n, round(avg(case when {q.haversine_m('fix_lat', 'fix_lon', 'latitude', 'longitude')} <= gate then 1e0 else 0e0 end), 6) as inside from ({draws(q, _EMITTERS, 4)}) f group by cue"
S["r7_water_cells"] = lambda q: f"select scene_id, gy, gx from (select s.scene_id, y.g as gy, x.g as gx, row_number() over (partition by s.scene_id order by ((s.scene_key * 64 + y.g * 8 + x.g) * 7919) % 100003, y.g, x.g) as k from scenes s cross join (values {', '.join(f'({i})' for i in range(8))}) as y(g) cross join (values {', '.join(f'({i})' for i in range(8))}) as x(g) where valid_pct >= 75 and (s.scene_key + y.g * x.g) % 5 <> 0) t where k <= 10"
S["r9_no_emitters"] = lambda q: "select d.scene_id, count(*) as before, count(f.pos) as after from contacts d left join (select * from structures where pos < 0) f on f.scene_id = d.scene_id group by d.scene_id"
_TRIAL_CONTACT = "select contact_key as emitter, scene_id, latitude, longitude from contacts where contact_key % 40 = 0"
S["r10_single_emitter"] = lambda q: f"select cue, count(*) as trials, round(avg(n), 6) as mean_n, max(n) as top, round(100 * avg(case when n = 0 then 1e0 else 0e0 end), 4) as clean_pct from (select f.cue, f.emitter, f.trial, sum(case when d.contact_key <> f.emitter and {q.haversine_m('f.fix_lat', 'f.fix_lon', 'd.latitude', 'd.longitude')} <= f.gate then 1 else 0 end) as n from ({draws(q, _TRIAL_CONTACT, 3)}) f left join contacts d on d.scene_id = f.scene_id group by f.cue, f.emitter, f.trial) t group by cue"
S["r11_lost_misses"] = lambda q: "select count(*) as lost from (select concat('MISS_', scene_id, '_', cast(mmsi as varchar(20))) as id from catalog except select concat('MISS_', scene_id, '_', cast(mmsi as varchar(20))) from nearest_fix) t"
S["r12_scene_gating"] = lambda q: f"select cue, trial, scene_id, count(*) as contacts_n, sum(case when near <= gate then 1 else 0 end) as retained from (select f.cue, f.trial, d.scene_id, d.detection_id, max(f.gate) as gate, min({q.haversine_m('f.fix_lat', 'f.fix_lon', 'd.latitude', 'd.longitude')}) as near from contacts d join (select * from ({draws(q, _EMITTERS + ' where length_m >= 150', 2)}) z) f on f.scene_id = d.scene_id group by f.cue, f.trial, d.scene_id, d.detection_id) t group by cue, trial, scene_id"
S["r13_by_scene"] = lambda q: "select scene_id, count(*) as n, min(detection_id) as first, max(detection_id) as last from contacts group by scene_id"
