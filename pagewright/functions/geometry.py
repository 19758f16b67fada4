"""Box expressions.  A box is four double columns (x0, y0, x1, y1), origin top-left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import settings as S


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in ("x0", "y0", "x1", "y1"))


def _clip(v: Column, upper: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, upper))


def clamp_bbox(b, width, height) -> dict[str, Column]:
    """Clip to the page, order the corners, round to two decimals."""
    x0, y0, x1, y1 = b
    x0, x1, y0, y1 = _clip(x0, width), _clip(x1, width), _clip(y0, height), _clip(y1, height)

    def fix(c):
        # whole numbers are spared the detour over decimals
        return F.when(F.rint(c) == c, c).otherwise(F.bround(c, S.BBOX_DECIMALS))

    return {
        "x0": fix(F.least(x0, x1)), "y0": fix(F.least(y0, y1)),
        "x1": fix(F.greatest(x0, x1)), "y1": fix(F.greatest(y0, y1)),
    }


def bbox_area(b) -> Column:
    x0, y0, x1, y1 = b
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def overlap_ratio(inner, outer) -> Column:
    """Shared area over the inner area; 0 when the inner box is empty."""
    shared = bbox_area(
        (
            F.greatest(inner[0], outer[0]), F.greatest(inner[1], outer[1]),
            F.least(inner[2], outer[2]), F.least(inner[3], outer[3]),
        )
    )
    area = bbox_area(inner)
    return F.when(area > 0, shared / area).otherwise(F.lit(0.0))


def vertical_distance(a, b) -> Column:
    return F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])


def pixels_to_points(left, top, width, height, dpi, page_width, page_height) -> dict[str, Column]:
    scale = F.lit(72.0) / dpi
    return clamp_bbox(
        (left * scale, top * scale, (left + width) * scale, (top + height) * scale),
        page_width, page_height,
    )
