"""Scalar and array functions as Columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def wavelength(text: Column) -> Column:
    """The first run of digits of a name as a number; null without one."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def rgb(colour: Column) -> Column:
    """struct<r,g,b> of "#rgb" or "#rrggbb"; a short code doubles each digit."""
    bare = F.regexp_replace(colour, "^#", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def luminance(colour: Column) -> Column:
    """Relative luminance of a hex colour, 0 to 255."""
    x = rgb(colour)
    return 0.2126 * x["r"] + 0.7152 * x["g"] + 0.0722 * x["b"]


#: Seconds in a unit of time.
UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0}


def frequency(text: str) -> float:
    """Hertz of a period such as "200ms"."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*(ns|us|ms|s)\s*", text)
    if not m or not float(m[1]):
        raise ValueError(f"not a period: {text!r}")
    return 1 / (float(m[1]) * UNITS[m[2]])


def frequency_of(text: Column) -> Column:
    """The same of a column; null for what is not a period."""
    unit = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    number = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)\s*(ns|us|ms|s)\s*$", 1).try_cast("double")
    scale = F.element_at(unit, F.nullif(F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)\s*(ns|us|ms|s)\s*$", 2), F.lit("")))
    return F.try_divide(F.lit(1.0), number * scale)


def differences(values: Column) -> Column:
    """Each element less the one before it; one shorter."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda a, b: a - b)


def arg_max(values: Column) -> Column:
    """Place of the first greatest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def mean_of(*columns: Column) -> Column:
    """Row-wise mean of the columns that are not null."""
    kept = F.array_compact(F.array(*columns))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept))


def sector(angle: Column, width: int = 45) -> Column:
    """The middle of the angle's sector, sectors centred on multiples of width, 0 to 360."""
    return (F.floor((angle + width / 2) / width) * width % 360).cast("long")


def opsin(wavelength: Column, peak: Column) -> Column:
    """Absorption by the A1 pigment template: alpha band and beta band. The constants are the template's fixed values."""
    x = peak / wavelength
    a = 0.8795 + 0.0459 * F.exp(-F.pow(peak - 300, F.lit(2.0)) / 11940)
    alpha = 1 / (F.exp(69.7 * (a - x)) + F.exp(28 * (0.922 - x)) + F.exp(-14.9 * (1.104 - x)) + 0.674)
    beta = 0.26 * F.exp(-F.pow((wavelength - (189 + 0.315 * peak)) / (-40.5 + 0.195 * peak), F.lit(2.0)))
    return alpha + beta


def chirp_frequency(t: Column, duration: float, f0: float, f1: float) -> Column:
    """Frequency of an exponential chirp from f0 to f1."""
    return f0 * F.exp(t / duration * math.log(f1 / f0))


def chirp_value(t: Column, duration: float, f0: float, f1: float) -> Column:
    """Sine whose frequency runs linearly from f0 to f1 over the duration."""
    return F.sin(2 * math.pi * (f0 * t + (f1 - f0) / (2 * duration) * t * t))


def nearest(x: Column, places: list[float]) -> Column:
    """Index of the place nearest to x, the first of equally near ones; null for null."""
    near = F.array_min(F.array(*[F.struct(F.abs(x - p).alias("d"), F.lit(i).cast("long").alias("i")) for i, p in enumerate(places)]))
    return F.when(x.isNotNull(), near["i"])
