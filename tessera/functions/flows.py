"""Flow maps of the unit square in columns: where a reference point is at time t (0 to 1)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Map = Callable[[Column, Column, float], tuple[Column, Column]]


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def identity(x: Column, y: Column, t: float) -> tuple[Column, Column]:
    return x, y


def _turned(dx: Column, dy: Column, angle: Column, cx: float, cy: float) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return cx + c * dx - s * dy, cy + s * dx + c * dy


def rotation(omega: float, cx: float = 0.5, cy: float = 0.5) -> Map:
    """Rigid rotation by omega * t."""
    return lambda x, y, t: _turned(x - cx, y - cy, F.lit(omega * t), cx, cy)


def swirl(strength: float = 1.5, cx: float = 0.5, cy: float = 0.5, radius: float = 0.45, period: float = 1.0) -> Map:
    """Rotation that fades out towards a radius and swings forth and back within a period."""

    def at(x: Column, y: Column, t: float) -> tuple[Column, Column]:
        dx, dy = x - cx, y - cy
        inside = F.greatest(1.0 - (dx * dx + dy * dy) / (radius * radius), F.lit(0.0))
        return _turned(dx, dy, inside * inside * (strength * math.sin(2 * math.pi * t / period)), cx, cy)

    return at


def pulse(amplitude: float = 0.15, k: float = 2.0) -> Map:
    """A pulsating shear in a pattern of vortices."""

    def at(x: Column, y: Column, t: float) -> tuple[Column, Column]:
        a, kx, ky = amplitude * math.sin(math.pi * t), x * (k * math.pi), y * (k * math.pi)
        return x + a * F.sin(kx) * F.cos(ky), y - a * F.cos(kx) * F.sin(ky)

    return at


def compression(amplitude: float = 0.6, cx: float = 0.35, cy: float = 0.55, sigma: float = 0.18, period: float = 1.0) -> Map:
    """Points drawn to a centre by a Gaussian, and let go again within a period."""
    if not 0 < amplitude < 1 or sigma <= 0:
        raise ValueError("0 < amplitude < 1 and sigma > 0")

    def at(x: Column, y: Column, t: float) -> tuple[Column, Column]:
        dx, dy = x - cx, y - cy
        keep = 1.0 - F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) * (amplitude * math.sin(math.pi * t / period))
        return cx + keep * dx, cy + keep * dy

    return at


def composed(*maps: Map) -> Map:
    def at(x: Column, y: Column, t: float) -> tuple[Column, Column]:
        for m in maps:
            x, y = m(x, y, t)
        return x, y

    return at


def applied(m: Map, x: Column, y: Column, t: float) -> tuple[Column, Column]:
    """The map, held within the square."""
    a, b = m(x, y, t)
    return clamp(a), clamp(b)
