"""Degrees, metres and round numbers; columns and plain numbers alike."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres to a degree of latitude, and the least cosine of a latitude that is used (fixed values).
DEGREE_M, LEAST_COS = 111320.0, 0.05


def cos_latitude(latitude: float) -> float:
    return max(math.cos(math.radians(latitude if math.isfinite(latitude) else 0.0)), LEAST_COS)


def metres_to_degrees(m, latitude: float = 0.0):
    """Metres as degrees at a latitude; negative distances become -1, which stands for "automatic"."""
    per = DEGREE_M * cos_latitude(latitude)
    if isinstance(m, Column):
        return F.when(m < 0, F.lit(-1.0)).otherwise(m / per)
    return -1.0 if m < 0 else m / per


def square_degrees_to_m2(a, latitude: float = 0.0):
    return a * (DEGREE_M * DEGREE_M * cos_latitude(latitude))


def m2_to_square_degrees(a, latitude: float = 0.0):
    return a / (DEGREE_M * DEGREE_M * cos_latitude(latitude))


def degrees_to_m(d):
    return d * DEGREE_M


def nice_number(n):
    """The next of 1, 2, 5, 10 times a power of ten; 100 for numbers that aren't positive."""
    if isinstance(n, Column):
        power = F.pow(F.lit(10.0), F.floor(F.log10(n)))
        lead = n / power
        step = F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)
        return F.when(n.isNull() | (n <= 0), F.lit(100.0)).otherwise(step * power)
    if not n or n <= 0:
        return 100.0
    power = 10.0 ** math.floor(math.log10(n))
    lead = n / power
    return (1 if lead <= 1 else 2 if lead <= 2 else 5 if lead <= 5 else 10) * power


def area_label(m2: Column) -> Column:
    """Square metres as text, in km² from a million on."""
    return F.when(m2 >= 1e6, F.concat(F.format_string("%.2f", m2 / 1e6), F.lit(" km²"))).otherwise(F.concat(F.format_string("%.0f", m2), F.lit(" m²")))


def length_label(m: Column) -> Column:
    """Metres as text, in the largest unit of km, m, cm and mm that leaves one or more."""
    return (
        F.when(m >= 1000, F.concat(F.format_string("%.2f", m / 1000), F.lit(" km")))
        .when(m >= 1, F.concat(F.format_string("%.1f", m), F.lit(" m")))
        .when(m >= 0.01, F.concat(F.format_string("%.1f", m * 100), F.lit(" cm")))
        .otherwise(F.concat(F.format_string("%.1f", m * 1000), F.lit(" mm")))
    )
