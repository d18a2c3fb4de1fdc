"""Column expressions of the point-cloud engine; all of them stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a patch, of its margin and of a texel; texels of a patch and of its context; points of a chunk (fixed values).
PATCH, MARGIN, TEXEL, TEXELS, CONTEXT_TEXELS, CHUNK = 640.0, 160.0, 10.0, 64, 96, 50_000
#: Radius by which samples are normalised, and the factor by which the interpolation grid differs from it.
RADIUS = 0.5**0.5 * 10 * 96 * 1.5
RADIUS_OUT = 0.5**0.5 * 10 * 64 * 1.5
STRETCH = 103.0 / 96.0 * (1.0 - 1.0 / 96.0)
U32 = 1 << 32


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def dequantised(raw: Column, scale: float, offset: float = 0.0) -> Column:
    """Coordinate of a fixed-point integer."""
    return raw.cast("double") * F.lit(scale) + F.lit(offset)


def colour8(channel: Column) -> Column:
    """8-bit channel of a 16-bit one; values that already fit stay."""
    return F.when(channel > 255, F.floor(channel / 256).cast("int")).otherwise(channel)


def local(value: Column, low: Column, size: Column) -> Column:
    """Coordinate from the world's minimum, inside the world."""
    return clamp(value - low, 0.0, size)


def cell(value: Column, size: float = PATCH) -> Column:
    """Grid cell of a coordinate."""
    return F.floor(value / F.lit(size)).cast("int")


def sector(value: Column, low: Column, size: float = PATCH) -> Column:
    """Third of a patch: 0 up to a quarter, 2 from three quarters on, else 1."""
    part = value - low
    return F.when(part <= 0.25 * size, 0).when(part < 0.75 * size, 1).otherwise(2)


def texel(value: Column) -> Column:
    """Texel number over all patches; texels lie around multiples of their size."""
    return F.floor((value + TEXEL / 2) / TEXEL).cast("int")


def patch_edge(index: Column, at: float = 0.0, size: float = PATCH) -> Column:
    """Minimum (0), centre (0.5) or maximum (1) of a patch along an axis."""
    return (index + F.lit(at)) * F.lit(size)


def patch_count(size: Column, patch: float = PATCH) -> Column:
    return (F.ceil(size / patch) + 1).cast("int")


def chunk_count(points: Column, chunk: int = CHUNK) -> Column:
    return F.floor((points + (chunk - 1)) / chunk).cast("long")


def normalised(value: Column, centre: Column, stretch: float = STRETCH) -> Column:
    return (value - centre) / F.lit(RADIUS) * F.lit(stretch)


def normalised_height(z: Column, centre: Column) -> Column:
    return (z - centre) / F.lit(RADIUS) * F.lit(10.0)


def denormalised_height(h: Column, centre: Column) -> Column:
    return h / F.lit(10.0) * F.lit(RADIUS_OUT) + centre


def packed(r: Column, g: Column, b: Column, a: Column | int = 255) -> Column:
    """32-bit colour, red lowest, as a long."""
    a = F.lit(a) if isinstance(a, int) else a
    return r.cast("long") + g.cast("long") * 256 + b.cast("long") * 65536 + a.cast("long") * 16777216


def channel(colour: Column, k: int) -> Column:
    return F.pmod(F.floor(colour / F.lit(256**k)), F.lit(256)).cast("int")


def index_colour(index: Column) -> Column:
    """A colour to tell neighbours apart, as 32 unsigned bits."""
    return F.pmod((F.pmod(index, F.lit(127)) + 1).cast("long") * 12345678, F.lit(U32))


def smoothstep(u: Column) -> Column:
    return u * u * (3.0 - 2.0 * u)


def lerp(a: Column, b: Column, u: Column) -> Column:
    return a + (b - a) * u


def gauss(x: Column, mean: float, sigma: float, pi: float = 3.1415) -> Column:
    """Normal density, with the constant that the callers expect."""
    return F.exp(-0.5 * ((x - mean) / sigma) * ((x - mean) / sigma)) / F.lit(sigma * (2 * pi) ** 0.5)


#: Ramp of eleven colours, from low to high (fixed values).
RAMP = ((158, 1, 66), (213, 62, 79), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191), (230, 245, 152), (171, 221, 164), (102, 194, 165), (50, 136, 189), (94, 79, 162))


def ramp(u: Column, k: int) -> Column:
    """Channel k of the ramp at 0 to 1, linear between its colours."""
    levels = F.array(*[F.lit(float(c[k])) for c in RAMP])
    at = clamp(u, 0.0, 1.0) * F.lit(float(len(RAMP) - 1))
    low = F.least(F.floor(at).cast("int"), F.lit(len(RAMP) - 2))
    return F.floor(lerp(levels[low], levels[low + 1], at - low)).cast("int")


def round_up(value: Column, step: int) -> Column:
    return (F.ceil(value / step) * step).cast("long")


def barycentric(px: Column, py: Column, *corners: Column) -> list[Column]:
    """The three weights of a point in the triangle x0, y0, x1, y1, x2, y2; a hair in the denominator guards flat ones."""
    x0, y0, x1, y1, x2, y2 = corners
    whole = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) + F.lit(1e-5)
    a = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / whole
    b = ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / whole
    return [a, b, 1.0 - a - b]


def circumcircle(*corners: Column) -> list[Column]:
    """Centre x, y and squared radius; null for corners on a line."""
    x0, y0, x1, y1, x2, y2 = corners
    d = 2.0 * (x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1))
    s0, s1, s2 = x0 * x0 + y0 * y0, x1 * x1 + y1 * y1, x2 * x2 + y2 * y2
    flat = F.abs(d) < 1e-12
    cx = F.when(~flat, (s0 * (y1 - y2) + s1 * (y2 - y0) + s2 * (y0 - y1)) / d)
    cy = F.when(~flat, (s0 * (x2 - x1) + s1 * (x0 - x2) + s2 * (x1 - x0)) / d)
    return [cx, cy, (x0 - cx) * (x0 - cx) + (y0 - cy) * (y0 - cy)]


def inside(values: list[Column], lows: list[Column], highs: list[Column]) -> Column:
    """Point in box, borders included."""
    return reduce(lambda a, b: a & b, [(v >= low) & (v <= high) for v, low, high in zip(values, lows, highs, strict=True)])


def overlaps(low_a: list[Column], high_a: list[Column], low_b: list[Column], high_b: list[Column]) -> Column:
    """Boxes that touch or overlap."""
    return reduce(lambda a, b: a & b, [(la <= hb) & (lb <= ha) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True)])


def shaded(channel_value: Column, diffuse: float = 1.0) -> Column:
    """Channel of a lit fragment; light is even by default."""
    return F.floor(channel_value * F.lit(diffuse)).cast("int")


def drawn(alpha: Column, least: int = 150) -> Column:
    """Whether a fragment of that alpha is drawn at all."""
    return alpha >= least


def animation(time: Column, start: float, duration: float) -> Column:
    """Progress of an animation, 0 to 1."""
    return clamp((time - start) / duration, 0.0, 1.0)
