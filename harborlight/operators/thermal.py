"""Two-node thermal model stepped over ordered stages, with a profile ladder chosen by looking ahead."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Bus:
    area: float = 0.090
    emissivity: float = 0.85
    absorptivity: float = 0.20
    parasitic_w: float = 12.0
    r_k_per_w: float = 0.9
    soc_j_per_k: float = 120.0
    chassis_j_per_k: float = 1800.0
    junction_c: float = 25.0
    chassis_c: float = 20.0
    throttle_c: float = 95.0
    target_c: float = 80.0
    step_up_c: float = 20.0
    burst_guard_c: float = 12.0
    burst_relief_s: float = 300.0
    period_s: float = 5676.0
    eclipse: float = 0.35


#: Name, power of the mode in watts and scenes in flight.
LADDER = (("FULL", 25.0, 3), ("REDUCED", 15.0, 2), ("SURVEY", 15.0, 1), ("BEACON", 10.0, 1))
RUNG = {name: k for k, (name, _, _) in enumerate(LADDER)}
IDLE_W = 4.0
#: Forward simulation ends here.
HORIZON_S = 2 * 5676.0
_SIGMA, _SPACE, _SUN = 5.670374419e-8, 2.7, 1361.0


def advance(junction: float, chassis: float, seconds: float, watts: float, sunlit: bool, bus: Bus) -> tuple[float, float]:
    """Euler steps of at most 5 s."""
    sun = bus.absorptivity * _SUN * bus.area if sunlit else 0.0
    while seconds > 1e-9:
        h = min(5.0, seconds)
        seconds -= h
        flow = (junction - chassis) / bus.r_k_per_w
        out = bus.emissivity * _SIGMA * bus.area * ((chassis + 273.15) ** 4 - _SPACE**4)
        junction, chassis = junction + (watts - flow) / bus.soc_j_per_k * h, chassis + (flow + sun + bus.parasitic_w - out) / bus.chassis_j_per_k * h
    return junction, chassis


def steady(watts: float, sunlit: bool, bus: Bus) -> float:
    """Where the junction settles if this power is held."""
    load = watts + (bus.absorptivity * _SUN * bus.area if sunlit else 0.0) + bus.parasitic_w
    return (load / (bus.emissivity * _SIGMA * bus.area) + _SPACE**4) ** 0.25 - 273.15 + watts * bus.r_k_per_w


def is_sunlit(elapsed: float, bus: Bus) -> bool:
    """The orbit starts in eclipse."""
    return (elapsed / bus.period_s) % 1.0 >= bus.eclipse


def to_terminator(elapsed: float, bus: Bus) -> float:
    """Seconds to the next change of light, infinite where there is none."""
    if not 0.0 < bus.eclipse < 1.0:
        return math.inf
    phase = (elapsed / bus.period_s) % 1.0
    return ((bus.eclipse if phase < bus.eclipse else 1.0) - phase) * bus.period_s


def holdable(junction: float, chassis: float, watts: float, sunlit: bool, bus: Bus) -> float:
    """Seconds until this power reaches the throttle point, HORIZON_S at most."""
    if junction >= bus.throttle_c:
        return 0.0
    if steady(watts, sunlit, bus) < bus.throttle_c:
        return HORIZON_S
    seconds = 0.0
    while seconds < HORIZON_S:
        junction, chassis = advance(junction, chassis, 5.0, watts, sunlit, bus)
        seconds += 5.0
        if junction >= bus.throttle_c:
            return seconds
    return HORIZON_S


def select(junction: float, chassis: float, elapsed: float, bus: Bus) -> tuple[int, str]:
    """The rung that looking ahead justifies, and why: sustainable, else a burst that holds to the terminator, else the floor."""
    floor, sunlit = len(LADDER) - 1, is_sunlit(elapsed, bus)
    if junction >= bus.throttle_c:
        return floor, "at or above throttle; shed to floor"
    for k, (_, watts, _) in enumerate(LADDER):
        if steady(watts, sunlit, bus) < bus.target_c:
            return k, "sustainable"
        # only sunlight ends in relief; a die near the throttle point starts no burst
        if not sunlit or bus.throttle_c - junction < bus.burst_guard_c:
            continue
        if holdable(junction, chassis, watts, sunlit, bus) >= to_terminator(elapsed, bus) + bus.burst_relief_s:
            return k, "burst to the terminator"
    return floor, "nothing sustainable; floor"


def govern(stages: DataFrame, key: str, bus: Bus = Bus(), start: str = "FULL", enabled: bool = True, pin: str | None = None) -> DataFrame:
    """(key, seq, elapsed_s, profile, junction_c, chassis_c, chosen, reason) for stages(key, seq, seconds) of each key in order of seq.

    A stage runs at the profile in force, at its whole power or, with a column cores_busy, at the share of it that the cores take;
    then the profile is chosen anew. It falls at once, and rises only with step_up_c of headroom. profile is what is in force after
    the stage, chosen what select() picks: a pinned or disabled governor logs the choice and leaves the profile.
    """
    if pin is not None and pin not in RUNG:
        raise ValueError(f"pin {pin!r} is no rung of {sorted(RUNG)}")
    first = RUNG[start if pin is None else pin]
    busy = ["cores_busy"] if "cores_busy" in stages.columns else []

    def run(g: pd.DataFrame) -> pd.DataFrame:
        junction, chassis = bus.junction_c, bus.chassis_c
        elapsed, rung, out = 0.0, first, []
        for seq, seconds, *cores in g.sort_values("seq")[["seq", "seconds", *busy]].itertuples(index=False):
            seconds = 0.0 if pd.isna(seconds) else float(seconds)
            _, watts, scenes = LADDER[rung]
            if cores and not pd.isna(cores[0]):
                watts = IDLE_W + (watts - IDLE_W) * max(0.0, min(1.0, cores[0] / (2 * scenes)))
            junction, chassis = advance(junction, chassis, seconds, watts, is_sunlit(elapsed, bus), bus)
            elapsed += seconds
            chosen, reason = select(junction, chassis, elapsed, bus)
            pick = LADDER[chosen][0]
            if pin is not None:
                reason = f"pinned: {reason}"
            elif not enabled:
                reason = f"disabled: {reason}"
            elif chosen < rung and bus.throttle_c - junction < bus.step_up_c:
                reason = f"holding: {reason}"
            else:
                rung = chosen
            out.append((g[key].iloc[0], seq, elapsed, LADDER[rung][0], junction, chassis, pick, reason))
        return pd.DataFrame(out, columns=[key, "seq", "elapsed_s", "profile", "junction_c", "chassis_c", "chosen", "reason"])

    return stages.groupBy(key).applyInPandas(run, f"{key} {dict(stages.dtypes)[key]}, seq long, elapsed_s double, profile string, junction_c double, chassis_c double, chosen string, reason string")
