"""Geodesy as Column expressions; they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(3440.065 * 2) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(6371008.8 * 2) * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2))))


def dead_reckon(lat: Column, lon: Column, knots: Column, course: Column, hours: Column) -> tuple[Column, Column]:
    """Great-circle position after `hours`; longitude is not wrapped."""
    ang = knots * hours * 1.852 / 6371.0
    phi, theta = F.radians(lat), F.radians(course)
    new = F.asin(F.sin(phi) * F.cos(ang) + F.cos(phi) * F.sin(ang) * F.cos(theta))
    return F.degrees(new), F.degrees(F.radians(lon) + F.atan2(F.sin(theta) * F.sin(ang) * F.cos(phi), F.cos(ang) - F.sin(phi) * F.sin(new)))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def kelvin_knots(wavelength_m: Column) -> Column:
    return F.sqrt(9.80665 * wavelength_m / (2 * F.pi())) * 1.943844
