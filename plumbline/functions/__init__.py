"""Column functions: z-codes, bit sequences, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_encode(x: Column, y: Column, level: int) -> Column:
    """Bits of y and x in turn, y's first."""
    parts = []
    for i in range(level):
        parts.append(F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i))
        parts.append(F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return reduce(lambda a, b: a + b, parts)


def z_text(code: Column, level: int) -> Column:
    return F.lpad(F.bin(code), 2 * level, "0")


def z_decode(code: Column, level: int) -> tuple[Column, Column]:
    def half(shift: int) -> Column:
        return reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(code, 2 * i + shift).bitwiseAND(F.lit(1)), i) for i in range(level)])

    return half(0), half(1)


def in_triangle(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in or on a triangle: it is on one side of all three edges."""
    (ax, ay), (bx, by), (cx, cy) = corners
    signs = [(x - px) * (qy - py) - (y - py) * (qx - px) for (px, py), (qx, qy) in (((ax, ay), (bx, by)), ((bx, by), (cx, cy)), ((cx, cy), (ax, ay)))]
    return ((signs[0] >= 0) & (signs[1] >= 0) & (signs[2] >= 0)) | ((signs[0] <= 0) & (signs[1] <= 0) & (signs[2] <= 0))


def quarters(corners: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The four triangles between the corners and the middles of the edges; the middle one last."""
    a, b, c = corners
    ab, bc, ca = (((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in ((a, b), (b, c), (c, a)))
    return [[a, ab, ca], [ab, b, bc], [ca, bc, c], [ab, bc, ca]]


def first_region(x: Column, y: Column, regions: list[list[tuple[float, float]]]) -> Column:
    """The number of the first triangle that holds the point, or null."""
    return F.coalesce(*[F.when(in_triangle(x, y, r), F.lit(k)) for k, r in enumerate(regions)])
