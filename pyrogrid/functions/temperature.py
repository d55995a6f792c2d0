"""Grey value to temperature and back, display units and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Skin emissivity, reflected temperature in degrees C, zero of the Kelvin scale.
SKIN_EMISSIVITY = 0.98
REFLECTED_C = 20.0
KELVIN = 273.15


def _lit(value):
    return value if isinstance(value, Column) else F.lit(float(value))


def _fourth(k: Column) -> Column:
    return F.pow(k, F.lit(4.0))


def correct_emissivity(celsius: Column, emissivity=SKIN_EMISSIVITY,
                       reflected_c=REFLECTED_C) -> Column:
    """Object temperature after removing reflected radiance."""
    e = _lit(emissivity)
    measured = _fourth(celsius + KELVIN)
    reflected = (F.lit(1.0) - e) * _fourth(_lit(reflected_c) + KELVIN)
    radiance = (measured - reflected) / F.greatest(F.lit(0.01), e)
    return F.pow(F.greatest(F.lit(0.0), radiance), F.lit(0.25)) - KELVIN


def to_celsius(v: Column, t_min=20.0, t_max=40.0, emissivity: bool = False) -> Column:
    t = _lit(t_min) + v / F.lit(255.0) * (_lit(t_max) - _lit(t_min))
    return correct_emissivity(t) if emissivity else t


def to_unit(v: Column, unit: str = "C", t_min=20.0, t_max=40.0) -> Column:
    """Absolute value in C, F or K."""
    c = to_celsius(v, t_min, t_max)
    return {"C": c, "F": c * 9.0 / 5.0 + 32.0, "K": c + KELVIN}[unit]


def to_delta(v: Column, unit: str = "C", t_min=20.0, t_max=40.0) -> Column:
    """Difference in C, F or K; the range counts as one degree at least."""
    c = v / F.lit(255.0) * F.greatest(F.lit(1.0), _lit(t_max) - _lit(t_min))
    return c * 9.0 / 5.0 if unit == "F" else c


# Unit labels.
LABELS = {"C": "°C", "F": "°F", "K": "K"}


def as_text(value: Column, unit: str = "C") -> Column:
    """One decimal, rounded on the binary value (293.15 K is just below the half).

    The part after the point times 20 is exact for temperatures, and an odd whole number
    there is a true half, which goes to the even digit.
    """
    whole = F.floor(value)
    twentieths = (value - whole) * 20.0
    below = F.floor((twentieths - 1) / 2)
    half = twentieths == 2 * below + 1
    tenths = F.when(half, below + below % 2).otherwise(F.floor((twentieths + 1) / 2))
    return F.format_string("%.1f " + LABELS[unit], (whole * 10 + tenths) / 10.0)


def calibrate(v: Column, offset_c: Column, t_min: Column, t_max: Column) -> Column:
    """Add an offset in degrees to grey values, clipped to 0..255."""
    span = t_max - t_min
    span = F.when(span <= 0, F.lit(20.0)).otherwise(span)
    shift = F.bround(offset_c * 255.0 / span, 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(255), v + shift))


def repair_range(t_min: Column, t_max: Column) -> Column:
    """An empty range becomes one degree wide."""
    return F.when(t_max <= t_min, t_min + 1.0).otherwise(t_max)


def degrees_per_step(t_min: Column, t_max: Column) -> Column:
    return (repair_range(t_min, t_max) - t_min) / 255.0


def radiometric_to_grey(raw: Column, frame_max: Column, t_min=20.0, t_max=40.0) -> Column:
    """16-bit counts to 0..255 in single precision.

    Frames whose largest count exceeds 10000 hold centikelvin, the others decidegrees.
    """
    def f32(x):
        return F.lit(float(x)).cast("float")
    counts = raw.cast("float")
    celsius = F.when(frame_max > 10000, counts * f32(0.01) - f32(KELVIN)) \
        .otherwise(counts * f32(0.1))
    clipped = F.least(F.greatest(celsius, f32(t_min)), f32(t_max))
    scaled = ((clipped - f32(t_min)).cast("float") / (f32(t_max) - f32(t_min))).cast("float")
    return F.floor((scaled * f32(255)).cast("float")).cast("int")
