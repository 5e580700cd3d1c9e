"""Column expressions over points, matrices, quaternions, boxes and triangles.

Matrices are arrays of 16 doubles in column-major order; quaternions are structs or columns x, y, z, w.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def element(matrix: Column, row: int, col: int) -> Column:
    """Element of a column-major matrix."""
    return matrix[4 * col + row]


def _once(value: Column, f) -> Column:
    """f of a value that f uses more than once: bound, so that the value's own expression is not repeated."""
    return F.transform(F.array(value), f)[0]


def _places(n: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def to_rows(matrix: Column) -> Column:
    """Column-major to four rows."""
    return _once(matrix, lambda m: _places(4, lambda r: _places(4, lambda c: m[c * 4 + r])))


def to_column_major(rows: Column) -> Column:
    return _once(rows, lambda m: _places(16, lambda i: m[(i % 4).cast("int")][F.floor(i / 4).cast("int")]))


def transform_point(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(element(matrix, r, 0) * x + element(matrix, r, 1) * y + element(matrix, r, 2) * z + element(matrix, r, 3) for r in range(3))


def multiply(a: Column, b: Column) -> Column:
    """Matrix product; a function over places of operands that are bound once."""

    def product(m: Column) -> Column:
        a, b = m["a"], m["b"]

        def place(i: Column) -> Column:
            row, first = (i % 4).cast("int"), (i - i % 4).cast("int")
            return a[row] * b[first] + a[row + 4] * b[first + 1] + a[row + 8] * b[first + 2] + a[row + 12] * b[first + 3]

        return _places(16, place)

    return _once(F.struct(a.alias("a"), b.alias("b")), product)


def rigid_inverse(matrix: Column) -> Column:
    """Inverse of rotation and translation: the transpose, and the translation turned back."""
    return _once(matrix, _turned_back)


def _turned_back(matrix: Column) -> Column:
    t = [element(matrix, r, 3) for r in range(3)]
    back = [-(element(matrix, 0, r) * t[0] + element(matrix, 1, r) * t[1] + element(matrix, 2, r) * t[2]) for r in range(3)]
    turned = [element(matrix, c, r) for c in range(3) for r in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*turned[:3], zero, *turned[3:6], zero, *turned[6:], zero, *back, one)


def is_rigid_array(matrix: Column) -> Column:
    """16 finite numbers."""
    return (F.size(matrix) == 16) & F.forall(matrix, lambda x: finite(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def normalized_quaternion(x: Column, y: Column, z: Column, w: Column) -> tuple[Column, Column, Column, Column]:
    """Length one; the identity if the length is 1e-12 or less."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    small = n <= 1e-12
    return tuple(F.when(small, F.lit(d)).otherwise(v / n) for v, d in ((x, 0.0), (y, 0.0), (z, 0.0), (w, 1.0)))


def rotation(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def pose_matrix(q: tuple[Column, Column, Column, Column], t: tuple[Column, Column, Column]) -> Column:
    """Column-major matrix of a quaternion, normalised first, and a translation."""
    r = rotation(*normalized_quaternion(*q))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[v for c in range(3) for v in (r[0][c], r[1][c], r[2][c], zero)], *t, one)


def moved(matrix: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """The matrix with its translation moved."""
    return F.zip_with(matrix, F.array(*[F.lit(0.0)] * 12, dx, dy, dz, F.lit(0.0)), lambda m, d: m + d)


def quaternion(matrix: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w of a matrix's rotation, from whichever of trace and diagonal is largest."""
    m = [[element(matrix, r, c) for c in range(3)] for r in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    by_trace = trace > 0
    by_x = (m[0][0] > m[1][1]) & (m[0][0] > m[2][2])
    by_y = m[1][1] > m[2][2]
    s = F.when(by_trace, F.sqrt(trace + 1) * 2).when(by_x, F.sqrt(1 + m[0][0] - m[1][1] - m[2][2]) * 2).when(by_y, F.sqrt(1 + m[1][1] - m[0][0] - m[2][2]) * 2).otherwise(F.sqrt(1 + m[2][2] - m[0][0] - m[1][1]) * 2)
    turn_x, turn_y, turn_z = (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s
    xy, xz, yz, quarter = (m[0][1] + m[1][0]) / s, (m[0][2] + m[2][0]) / s, (m[1][2] + m[2][1]) / s, s / 4
    pick = lambda t, x, y, z: F.when(by_trace, t).when(by_x, x).when(by_y, y).otherwise(z)
    q = pick(turn_x, quarter, xy, xz), pick(turn_y, xy, quarter, yz), pick(turn_z, xz, yz, quarter), pick(quarter, turn_x, turn_y, turn_z)
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(v / n for v in q)


def quaternion_product(a: tuple, b: tuple) -> tuple[Column, Column, Column, Column]:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def euler_yxz(matrix: Column) -> tuple[Column, Column, Column]:
    """Degrees about x, y and z of a rotation applied in the order y, x, z."""
    m = lambda r, c: element(matrix, r, c)
    level = F.abs(m(1, 2)) < 0.9999999
    x = F.asin(-clamp(m(1, 2), -1.0, 1.0))
    y = F.when(level, F.atan2(m(0, 2), m(2, 2))).otherwise(F.atan2(-m(2, 0), m(0, 0)))
    z = F.when(level, F.atan2(m(1, 0), m(1, 1))).otherwise(F.lit(0.0))
    return F.degrees(x), F.degrees(y), F.degrees(z)


def euler_xyz(matrix: Column) -> tuple[Column, Column, Column]:
    """Degrees about x, y and z of a rotation applied in the order x, y, z."""
    m = lambda r, c: element(matrix, r, c)
    level = F.abs(m(0, 2)) < 0.9999999
    x = F.when(level, F.atan2(-m(1, 2), m(2, 2))).otherwise(F.atan2(m(2, 1), m(1, 1)))
    y = F.asin(clamp(m(0, 2), -1.0, 1.0))
    z = F.when(level, F.atan2(-m(0, 1), m(0, 0))).otherwise(F.lit(0.0))
    return F.degrees(x), F.degrees(y), F.degrees(z)


def turned_about_y(degrees: Column, base: tuple) -> tuple[Column, Column, Column, Column]:
    """A base quaternion turned about the y axis."""
    half, zero = F.radians(degrees) / 2, F.lit(0.0)
    return quaternion_product((zero, F.sin(half), zero, F.cos(half)), base)


def lifted_position(base: tuple, offsets: tuple) -> tuple[Column, Column, Column]:
    """A base moved by offsets whose second and third places are exchanged: y is up in the viewer, z in the model."""
    return base[0] + offsets[0], base[1] + offsets[2], base[2] + offsets[1]


def translation(x: Column, y: Column, z: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one, zero, zero, zero, zero, one, zero, zero, zero, zero, one, zero, x, y, z, one)


def decentred(matrix: Column, centre: tuple, child: Column) -> Column:
    """matrix as it was before its content was moved to the centre, where it was a child that was moved."""
    return F.when(child, multiply(matrix, translation(*[-c for c in centre]))).otherwise(matrix)


def desired_world(cloud: Column, alignment: Column, centre: tuple) -> Column:
    """Where a model belongs: the cloud's matrix, the alignment undone, the model's centre put back."""
    return multiply(multiply(cloud, rigid_inverse(alignment)), translation(*centre))


def calibration_matrix(matrix: Column) -> Column:
    """A quarter turn back about x after the inverse; null unless the matrix holds 16 finite numbers."""
    quarter = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)])
    return F.when(is_rigid_array(matrix), multiply(quarter, rigid_inverse(matrix)))


def transform_delta(a: Column, b: Column) -> tuple[Column, Column]:
    """Length of the translation and degrees of the rotation that lead from a to b."""
    shift = F.sqrt(sum(((b[i] - a[i]) * (b[i] - a[i]) for i in (13, 14)), (b[12] - a[12]) * (b[12] - a[12])))
    trace = sum((element(a, r, c) * element(b, r, c) for r in range(3) for c in range(3) if (r, c) != (0, 0)), element(a, 0, 0) * element(b, 0, 0))
    return shift, F.degrees(F.acos(clamp((trace - 1) / 2, -1.0, 1.0)))


def same_pose(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, eps: float) -> Column:
    return (lon_a - lon_b) * (lon_a - lon_b) + (lat_a - lat_b) * (lat_a - lat_b) <= eps * eps


def wrap_degrees(v: Column) -> Column:
    """To (-180, 180]."""
    turned = F.pmod(v + 180, F.lit(360.0)) - 180
    return F.when(turned == -180, F.lit(180.0)).otherwise(turned)


def view_angles(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude in [-180, 180), latitude within 85 degrees, both to 6 decimals."""
    return F.round(F.pmod(lon + 180, F.lit(360.0)) - 180, 6), F.round(clamp(lat, -85.0, 85.0), 6)


def orientation(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an offset, y being up."""
    n = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.degrees(F.atan2(dx, dz)), F.lit(90.0) - F.degrees(F.acos(clamp(dy / n, -1.0, 1.0)))


def round_to_step(v: Column, step: Column) -> Column:
    return F.floor(v / step + 0.5) * step


def step_decimals(step: Column) -> Column:
    """Digits after the point of a step's shortest decimal form, at most 3; 2 for what is no step."""
    digits = F.when(step == F.round(step, 0), 0).when(step == F.round(step, 1), 1).when(step == F.round(step, 2), 2).otherwise(3)
    return F.when(finite(step) & (step > 0), digits).otherwise(2)


def adjust_step(text: Column, low: float, high: float, fallback: float) -> Column:
    """A step as a multiple of low within [low, high]; the fallback for what is no positive number."""
    v = text.try_cast("double")
    return F.when(finite(v) & (v > 0), clamp(round_to_step(v, F.lit(low)), low, high)).otherwise(F.lit(fallback))


def bounded_threshold(text: Column, low: float, high: float, fallback: float) -> Column:
    v = text.try_cast("double")
    return F.when(finite(v), clamp(F.round(v, 2), low, high)).otherwise(F.lit(fallback))


def positive_or(v: Column, default: float) -> Column:
    """v, or the default where it isn't above zero."""
    return F.when(v > 0, v).otherwise(F.lit(default))


def slider_range(*offsets: Column) -> Column:
    """50 or the largest offset, with 5 to spare, up to the next multiple of 5."""
    return F.ceil((F.greatest(F.lit(50.0), *[F.abs(o) for o in offsets]) + 5) / 5) * 5


def clip_step(span: Column) -> Column:
    return F.when(finite(span) & (span > 0), F.greatest(span / 1000, F.lit(1e-6))).otherwise(F.lit(0.001))


def clip_face(low: Column, high: Column, base_low: Column, base_high: Column, upper: bool) -> tuple[Column, Column, Column]:
    """(position, least, most) of a clip box's lower or upper face on an axis."""
    return (high, low, base_high) if upper else (low, base_low, high)


def clip_face_offset(value: Column, low: Column, high: Column, base_low: Column, base_high: Column, upper: bool) -> Column:
    """The offset that puts a face at value, as far as the other face lets it."""
    return base_high - F.least(F.greatest(value, low), base_high) if upper else F.least(F.greatest(value, base_low), high) - base_low


def pointer_place(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A pointer in device coordinates, -1 to 1, y upwards; null in an empty frame."""
    return (x - left) / F.nullif(width, F.lit(0.0)) * 2 - 1, -((y - top) / F.nullif(height, F.lit(0.0)) * 2) + 1


def followed(source: tuple, source_base: tuple, target_base: tuple) -> tuple:
    """The target moved from its base as the source was from its own."""
    return tuple(t + s - b for s, b, t in zip(source, source_base, target_base, strict=True))


def followed_distance(source: Column, source_base: Column, target_base: Column) -> Column:
    """The target's distance zoomed as the source's; null where the ratio isn't a positive number."""
    ratio = source / F.nullif(source_base, F.lit(0.0))
    return F.when(finite(ratio) & (ratio > 0), target_base * ratio)


def eye_dome_shade(depth: Column, neighbours: Column, strength: Column) -> Column:
    """Darkening of a pixel from its eight neighbours' depths (null: background): exp of minus 220 times strength and the mean rise in octaves, at least 0.22."""
    rise = F.aggregate(neighbours, F.lit(0.0), lambda s, z: s + F.coalesce(F.greatest(F.lit(0.0), F.log2(z) - F.log2(depth)), F.lit(0.0)))
    return F.when(depth.isNull(), F.lit(1.0)).otherwise(F.greatest(F.exp(-rise / 8 * 220 * strength), F.lit(0.22)))


def sphere_box(centre: tuple, radius: Column) -> tuple[tuple, tuple]:
    """(lower, upper) corners of the box around a sphere."""
    return tuple(c - radius for c in centre), tuple(c + radius for c in centre)


def fit_distance(dx: Column, dy: Column, dz: Column, degrees: float = 60.0) -> Column:
    """How far a camera of that vertical angle stands to see a box."""
    radius = F.sqrt(dx * dx + dy * dy + dz * dz) / 2
    return radius / F.sin(F.lit(math.radians(degrees / 2)))


def distance(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def height_difference(a: tuple, b: tuple) -> Column:
    return F.abs(b[1] - a[1])


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: tuple, b: tuple) -> tuple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def ray_plane(origin: tuple, direction: tuple, point: tuple, normal: tuple) -> Column:
    """How far along the ray it meets the plane; null if parallel or behind."""
    slope = dot(direction, normal)
    t = dot(minus(point, origin), normal) / F.nullif(slope, F.lit(0.0))
    return F.when(t >= 0, t)


def ray_triangle(origin: tuple, direction: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """How far along the ray it hits the triangle; null if it doesn't."""
    e1, e2 = minus(b, a), minus(c, a)
    p = cross(direction, e2)
    det = F.nullif(dot(e1, p), F.lit(0.0))
    s = minus(origin, a)
    u = dot(s, p) / det
    q = cross(s, e1)
    v, t = dot(direction, q) / det, dot(e2, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def triangle_area(ab: Column, bc: Column, ca: Column, a: tuple, b: tuple, c: tuple) -> Column:
    return length(cross(minus(b, a), minus(c, a))) / 2


def triangle_quality(ab: Column, bc: Column, ca: Column, area: Column) -> Column:
    """Twice the in-radius over the circum-radius: 1 for an equilateral triangle. Areas below 1e-12 count as that."""
    safe = F.greatest(area, F.lit(1e-12))
    return 2 * (safe / ((ab + bc + ca) / 2)) / (ab * bc * ca / (4 * safe))


def chord_error_mm(edge: Column, radius: float = 0.1) -> Column:
    return edge * edge / (8 * radius) * 1000


def deviation_percent(mean: Column, target: float) -> Column:
    return (mean - target) / target * 100


def sliver_threshold(target: Column, ratio: Column, tolerance: Column) -> Column:
    return F.least(target * ratio, tolerance)


def barycentric(p: tuple, a: tuple, b: tuple, c: tuple) -> tuple[Column, Column, Column]:
    """Weights of a, b and c for p's foot on the triangle, within [0, 1] and adding up to one."""
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    det = d00 * d11 - d01 * d01
    flat = F.abs(det) < 1e-20
    v = F.when(flat, F.lit(0.0)).otherwise((d11 * d20 - d01 * d21) / F.when(flat, F.lit(1.0)).otherwise(det))
    w = F.when(flat, F.lit(0.0)).otherwise((d00 * d21 - d01 * d20) / F.when(flat, F.lit(1.0)).otherwise(det))
    u, v, w = clamp(1 - v - w, 0.0, 1.0), clamp(v, 0.0, 1.0), clamp(w, 0.0, 1.0)
    total = F.greatest(u + v + w, F.lit(1e-20))
    return u / total, v / total, w / total


def box_volume(lo: tuple, hi: tuple) -> Column:
    sides = [F.greatest(h - low, F.lit(0.0)) for low, h in zip(lo, hi, strict=True)]
    return sides[0] * sides[1] * sides[2]


def box_iou(alo: tuple, ahi: tuple, blo: tuple, bhi: tuple) -> Column:
    """Shared over joint volume; 0 if the joint volume is below 1e-12."""
    lo = tuple(F.greatest(a, b) for a, b in zip(alo, blo, strict=True))
    hi = tuple(F.least(a, b) for a, b in zip(ahi, bhi, strict=True))
    shared = box_volume(lo, hi)
    joint = box_volume(alo, ahi) + box_volume(blo, bhi) - shared
    return F.when(joint < 1e-12, F.lit(0.0)).otherwise(shared / joint)


def clip_offsets(low: Column, high: Column, span: Column) -> tuple[Column, Column]:
    """Both offsets in [0, span]; the upper one gives way so that together they stay within span."""
    low = clamp(low, 0.0, float("inf"))
    low = F.least(low, span)
    return low, F.least(F.greatest(high, F.lit(0.0)), span - low)
