"""Column functions: Morton codes, bits, colours, vectors, level-of-detail scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 21 bits of a coordinate.
AXIS = 0x1FFFFF
#: Bits of a coordinate that a look-up takes together: 6 to spread them, 2 of each axis to gather them.
_WIDE, _NARROW = 6, 2
_SPREAD = [sum((v >> i & 1) << 3 * i for i in range(_WIDE)) for v in range(1 << _WIDE)]
_GATHER = [sum((c >> 3 * i + axis & 1) << i + 21 * axis for i in range(_NARROW) for axis in range(3)) for c in range(1 << 3 * _NARROW)]
MASK32 = 0xFFFFFFFF


def _band(a: Column, b: int) -> Column:
    return a.bitwiseAND(F.lit(b).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def spread(v: Column) -> Column:
    """The 21 low bits of a coordinate, each at three times its place: four look-ups, so that a code of codes stays small."""
    v, known = v.cast("long"), _table(_SPREAD)
    out = None
    for at in range(0, 21, _WIDE):
        part = F.shiftleft(F.get(known, _band(F.shiftright(v, at), (1 << min(_WIDE, 21 - at)) - 1).cast("int")), 3 * at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Morton code of coordinates below 2^21, x lowest."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def demorton(code: Column) -> tuple[Column, Column, Column]:
    """The coordinates of a code: look-ups gather the three side by side in one number, from which each is cut."""
    code, known = code.cast("long"), _table(_GATHER)
    packed = None
    for at in range(0, 21, _NARROW):
        part = F.shiftleft(F.get(known, _band(F.shiftright(code, 3 * at), (1 << 3 * min(_NARROW, 21 - at)) - 1).cast("int")), at)
        packed = part if packed is None else packed.bitwiseOR(part)
    return _band(packed, AXIS), _band(F.shiftright(packed, 21), AXIS), _band(F.shiftright(packed, 42), AXIS)


def children(code: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: code * 8 + c)


def parent(code: Column) -> Column:
    return F.shiftright(code, 3)


def nodes_at(level: int) -> int:
    return 1 << 3 * level


def output_index(code: Column, level: Column, target: Column) -> Column:
    """First place of a node of ``level`` among the nodes of the finer level ``target``."""
    return code * F.pow(F.lit(8.0), target - level).cast("long")


def times32(v: Column, k: int) -> Column:
    """v * k modulo 2^32 without overflow, by halves of k."""
    return _band(F.shiftleft(_band(v * (k >> 16), 0xFFFF), 16) + v * (k & 0xFFFF), MASK32)


def low_high(label: Column) -> tuple[Column, Column]:
    return _band(label, MASK32), F.shiftrightunsigned(label, 32)


def label_color(label: Column, alpha: int = 0x40) -> Column:
    """Packed colour of a label by hash, R lowest; label 0 is 0."""
    lo, hi = low_high(label)
    lo = lo.bitwiseXOR(hi)
    lo = times32(lo.bitwiseXOR(F.shiftright(lo, 16)), 0x7FEB352D)
    lo = lo.bitwiseXOR(F.shiftright(lo, 15))
    hi = hi.bitwiseXOR(lo)
    hi = times32(hi.bitwiseXOR(F.shiftright(hi, 16)), 0x85EBCA6B)
    hi = hi.bitwiseXOR(F.shiftright(hi, 13))
    return F.when(label == 0, F.lit(0).cast("long")).otherwise(pack(_band(lo, 255), _band(F.shiftright(lo, 8), 255), _band(F.shiftright(hi, 8), 255), F.lit(alpha)))


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    return r.cast("long") + g.cast("long") * 256 + b.cast("long") * 65536 + a.cast("long") * 16777216


def unpack(rgba: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(_band(F.shiftright(rgba, 8 * i), 255) for i in range(4))


def hsl_to_rgb(h: Column, s: Column, l: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Channels in 0 to 255, rounded half up, of a hue in degrees below 360."""
    c = (1 - F.abs(2 * l - 1)) * s
    sextant = h / 60
    x = c * (1 - F.abs(sextant - 2 * F.floor(sextant / 2) - 1))
    m, zero = l - c / 2, F.lit(0.0)
    order = ((c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x))
    out = []
    for i in range(3):
        value = order[5][i]
        for k in range(4, -1, -1):
            value = F.when(h < 60 * (k + 1), order[k][i]).otherwise(value)
        out.append(F.floor((value + m) * 255 + 0.5))
    return tuple(out)


def highlight(rgba: Column) -> Column:
    """Channels brightened by 1.8 up to 255; alpha stays."""
    r, g, b, a = unpack(rgba)
    up = lambda v: F.least(F.lit(255), F.floor(v * 1.8))
    return pack(up(r), up(g), up(b), a)


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def normalized(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector of length 0 stays as it is."""
    n = norm(x, y, z)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return x / n, y / n, z / n


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def camera_basis(d) -> tuple[tuple, tuple, tuple]:
    """Forward, right and up of a view direction; the world's up is +Y, or +X for views along it."""
    f = normalized(*d)
    steep = F.abs(f[1]) > 0.999
    up = F.when(steep, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(steep, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(0.0)
    r = normalized(*cross(f, up))
    return f, r, cross(r, f)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def orbit_position(center, radius: Column, yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    pitch = clamp(pitch, -math.pi / 3, math.pi / 3)
    return center[0] + radius * F.cos(pitch) * F.sin(yaw), center[1] + radius * F.sin(pitch), center[2] + radius * F.cos(pitch) * F.cos(yaw)


def zoomed(radius: Column, delta: Column, speed: float = 1.0) -> Column:
    return radius * F.exp(delta * speed * 0.0015)


def light_direction(angle: float) -> tuple[float, float, float]:
    a = math.radians(angle)
    return math.sin(a), 0.6, -math.cos(a)


def lod_scale(lod: Column, size: int) -> Column:
    return F.pow(F.lit(2.0), lod) / size


def grown(current: int, required: int, least: int) -> int:
    """Capacity of a pool that grows by half until it holds ``required``."""
    size = max(current, least)
    while size < required:
        size = math.ceil(size * 1.5)
    return size


def nibbles(data: Column) -> Column:
    """Array of the half bytes of a binary column, high half first."""
    return F.transform(F.filter(F.split(F.hex(data), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
