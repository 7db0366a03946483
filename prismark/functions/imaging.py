"""Cameras, scale and confidences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Matrix, Vector, add, col, rotate, subtract, transpose, unit


def pixel_direction(u, v, fx, fy, cx, cy) -> Vector:
    """Unit direction of a pixel, or of a vanishing point, in camera coordinates."""
    return unit(((col(u) - col(cx)) / col(fx), (col(v) - col(cy)) / col(fy), F.lit(1.0)))


def pixel_ray(u, v, k: tuple, r: Matrix) -> Vector:
    """Unit direction of an observation in the world; r turns camera coordinates into world ones."""
    return rotate(r, pixel_direction(u, v, *k))


def project(point: Vector, k: tuple, r: Matrix, origin: Vector) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a world point in a camera."""
    fx, fy, cx, cy = (col(c) for c in k)
    x, y, z = rotate(transpose(r), subtract(point, origin))
    safe = F.nullif(z, F.lit(0.0))
    return fx * x / safe + cx, fy * y / safe + cy, z


def stereo_point(u, v, disparity, f, baseline, cx, cy) -> Vector:
    """Point of a rectified pair by the textbook relation Z = f B / d; null for no disparity."""
    z = col(f) * col(baseline) / F.nullif(col(disparity).cast("double"), F.lit(0.0))
    return (col(u) - col(cx)) * z / col(f), (col(v) - col(cy)) * z / col(f), z


def mm_per_pixel(millimetres, x1, y1, x2, y2) -> Column:
    return col(millimetres) / F.nullif(F.hypot(col(x2) - col(x1), col(y2) - col(y1)), F.lit(0.0))


def frame_confidence(vp1, vp2, vp3) -> Column:
    return (col(vp1) + col(vp2) + col(vp3)) / 3


def plane_confidence(vp1, vp2) -> Column:
    return (col(vp1) + col(vp2)) / 2


#: Fixed value: what a box has over its frame.
BOX_BONUS = 0.15
#: Our choice for the law that the samples do not give: an extrusion axis as a share of its vanishing point.
EXTRUSION_SHARE = 0.94967


def box_confidence(vp1, vp2, vp3) -> Column:
    return F.least(F.lit(1.0), frame_confidence(vp1, vp2, vp3) + BOX_BONUS)


def extrusion_confidence(vp1) -> Column:
    return col(vp1) * EXTRUSION_SHARE


#: Fixed value: the greatest adjustment that experience makes. The cap and the gain are our choice.
MOST_ADJUSTED, CAP, GAIN = 0.12, 0.999, 0.4


def adjusted_confidence(confidence, reliability, gain: float = GAIN, most: float = MOST_ADJUSTED, cap: float = CAP) -> Column:
    """A confidence moved by experience, within +-most, never to 1; unknown reliability moves nothing."""
    move = F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(gain) * (F.coalesce(col(reliability), F.lit(0.5)) - 0.5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), col(confidence) + move))


def refined_confidence(visual, dimension, gain: float = 0.25, cap: float = 0.96) -> Column:
    """A proposal's confidence once a dimension agrees with it; gain and cap are our choice."""
    return F.least(F.lit(cap), col(visual) + F.lit(gain) * F.when(col(dimension) > 0, 1.0).otherwise(0.0))


def normal_confidence(x) -> Column:
    """Percentages and fractions as fractions."""
    return F.when(col(x) > 1, col(x) / 100).otherwise(col(x).cast("double"))


def centred_base(length, outer=0.0) -> Column:
    """Where a part of a given length begins that shares the middle of an outer part; -length / 2 without one."""
    return (col(outer) - col(length)) / 2


def translation_mm(x, y, z) -> Column:
    return F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z))


def speed_mm_s(x, y, z, seconds) -> Column:
    return translation_mm(x, y, z) / F.nullif(col(seconds).cast("double"), F.lit(0.0))


def shape_estimate(width, height, edge_share) -> tuple[Column, Column]:
    """(shape, confidence) from a region's proportions; a heuristic of our choice."""
    ratio = F.greatest(col(width), col(height)) / F.nullif(F.least(col(width), col(height)).cast("double"), F.lit(0.0))
    kind = F.when(ratio < 1.15, "sphere").when(ratio < 1.8, "box").when(ratio < 4, "cylinder").otherwise("cone")
    return kind, F.least(F.lit(0.95), F.lit(0.5) + col(edge_share) / 2)


#: What a candidate's macro says of it, in Spanish as the format has it.
REASONS = {
    "extrusion_axis": "Familia dominante de líneas paralelas proyectadas hacia un punto de fuga",
    "plane": "Dos familias de paralelas definen direcciones de un plano",
    "box": "Tres puntos de fuga ortogonalizados definen un marco cartesiano tipo Manhattan",
}


def reason(kind) -> Column:
    out = F.lit(None).cast("string")
    for name, text in REASONS.items():
        out = F.when(col(kind) == name, text).otherwise(out)
    return out


def fixed(x, decimals: int) -> Column:
    """A number with a point and fixed decimals, rounded half up as the formats have it."""
    return F.format_string(f"%.{decimals}f", col(x).cast("double"))


def fixed_list(xs, decimals: int) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[fixed(x, decimals) for x in xs]), F.lit("]"))


def reached(origin: Vector, direction: Vector, length) -> Vector:
    return add(origin, tuple(c * col(length) for c in direction))


def distort(x: Column, y: Column, lens: tuple) -> tuple[Column, Column]:
    """Where a lens (k1, k2, p1, p2, k3: three radial terms, two tangential ones) puts normalised image coordinates."""
    k1, k2, p1, p2, k3 = lens
    r = x * x + y * y
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y


def undistorted(seen: DataFrame, k: tuple, lens: tuple, steps: int = 15, u: str = "u", v: str = "v") -> DataFrame:
    """`seen` with its columns `u` and `v` as a camera without that lens had seen them.

    The lens is inverted by a fixed count of steps, each a projection of its own so that expressions do not nest: what the lens adds at the last guess is taken
    off the place seen. A step leaves about three times the radial share of what was off, so a strong lens (over a fifth at the edge) needs more. Nulls stay null.
    """
    fx, fy, cx, cy = (col(c) for c in k)
    k1, k2, p1, p2, k3 = lens
    out = seen.withColumns({"__a": (F.col(u) - cx) / fx, "__b": (F.col(v) - cy) / fy}).withColumns({"__x": F.col("__a"), "__y": F.col("__b")})
    x, y, r = F.col("__x"), F.col("__y"), F.col("__r")
    for _ in range(steps):
        out = out.withColumn("__r", x * x + y * y).withColumn("__f", 1 + r * (k1 + r * (k2 + r * k3)))
        out = out.withColumns({"__x": (F.col("__a") - 2 * p1 * x * y - p2 * (r + 2 * x * x)) / F.col("__f"), "__y": (F.col("__b") - p1 * (r + 2 * y * y) - 2 * p2 * x * y) / F.col("__f")})
    return out.withColumns({u: x * fx + cx, v: y * fy + cy}).drop("__a", "__b", "__x", "__y", "__r", "__f")
