"""Vectors and rotations as tuples of scalar columns.

A 3-vector is a tuple of three columns, a rotation one of nine, row by row. Array functions would leave code generation, so
arrays appear only where rows are read or written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = tuple[Column, ...]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def vector(x, y, z) -> Vector:
    return col(x), col(y), col(z)


def of_array(a, first: int = 0) -> Vector:
    """Elements first, first + 1 and first + 2 of an array column."""
    return tuple(F.element_at(col(a), first + k + 1) for k in range(3))


def to_array(v: Vector) -> Column:
    return F.array(*v)


def positive_zero(x: Column) -> Column:
    """Negative zero as zero, so that values group and print alike."""
    return x + F.lit(0.0)


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vector, k) -> Vector:
    return tuple(x * col(k) for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Null components for the zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(x / n for x in a)


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def along(origin: Vector, direction: Vector, length) -> Vector:
    """Where a vector of a given length ends."""
    return add(origin, scale(direction, length))


def homogeneous_line(x1, y1, x2, y2) -> Vector:
    """The line through two image points, as their cross product."""
    return cross(vector(x1, y1, 1.0), vector(x2, y2, 1.0))


def rotate(r: Matrix, v: Vector) -> Vector:
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def transpose(r: Matrix) -> Matrix:
    return tuple(r[3 * j + i] for i in range(3) for j in range(3))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3))


def matrix_of_array(a) -> Matrix:
    return tuple(F.element_at(col(a), k + 1) for k in range(9))


def axis(r: Matrix, k: int) -> Vector:
    """Axis k of a camera in the world: column k of its rotation."""
    return r[k], r[3 + k], r[6 + k]


def determinant(r: Matrix) -> Column:
    return dot(cross((r[0], r[3], r[6]), (r[1], r[4], r[7])), (r[2], r[5], r[8]))


def quaternion_to_matrix(w, x, y, z) -> Matrix:
    """Rotation of a quaternion in the order w, x, y, z, which is our choice; it need not be normalised."""
    w, x, y, z = (col(c) for c in (w, x, y, z))
    s = F.lit(2.0) / F.nullif(w * w + x * x + y * y + z * z, F.lit(0.0))
    one = F.lit(1.0)
    return (
        one - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y),
        s * (x * y + w * z), one - s * (x * x + z * z), s * (y * z - w * x),
        s * (x * z - w * y), s * (y * z + w * x), one - s * (x * x + y * y),
    )


def matrix_to_quaternion(r: Matrix) -> tuple[Column, Column, Column, Column]:
    """The quaternion w, x, y, z with w not negative."""
    half = lambda t: F.sqrt(F.greatest(F.lit(0.0), t)) / 2
    sign = lambda q, s: F.when(s < 0, -q).otherwise(q)
    return (
        half(1 + r[0] + r[4] + r[8]),
        sign(half(1 + r[0] - r[4] - r[8]), r[7] - r[5]),
        sign(half(1 - r[0] + r[4] - r[8]), r[2] - r[6]),
        sign(half(1 - r[0] - r[4] + r[8]), r[3] - r[1]),
    )


def orthogonal_frame(first: Vector, second: Vector) -> tuple[Vector, Vector, Vector]:
    """A right-handed frame: X along the first direction, Y against what the second has across X, Z = X x Y."""
    x = unit(first)
    y = scale(unit(subtract(second, scale(x, dot(second, x)))), -1.0)
    return x, y, cross(x, y)


def solve3(m: Matrix, b: Vector) -> Vector:
    """m v = b by Cramer's rule; null if m is singular."""
    c0, c1, c2 = axis(m, 0), axis(m, 1), axis(m, 2)
    det = F.nullif(dot(cross(c0, c1), c2), F.lit(0.0))
    return dot(cross(b, c1), c2) / det, dot(cross(c0, b), c2) / det, dot(cross(c0, c1), b) / det
