"""Column builders over boxes (x0, y0, x1, y1) and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def ink_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(0.02)))


def count_similarity(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def risk(overall: Column, page: Column, zone: Column) -> Column:
    """high, medium or low, by the first bound that is missed."""
    return (
        F.when((overall < 0.45) | (page < 0.35) | (zone < 0.20), "high")
        .when((overall < 0.72) | (page < 0.60) | (zone < 0.45), "medium").otherwise("low")
    )


def near(margin: float) -> Column:
    """Whether box (x0, y0, x1, y1) and box (gx0, gy0, gx1, gy1) meet, each with a margin; touching edges don't count."""
    c = F.col
    return (c("x0") - margin < c("gx1")) & (c("gx0") - margin < c("x1")) & (c("y0") - margin < c("gy1")) & (c("gy0") - margin < c("y1"))
