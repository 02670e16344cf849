"""Column functions on boxes: points and pixels to normalised, keys, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def block_key(page: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    return F.concat_ws("_", page.cast("string"), *(round_half_up(x).cast("string") for x in (left, bottom, right, top)))


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalized(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Points from the bottom left to shares of the page from its top left."""
    parts = {"x": F.try_divide(x, page_width), "y": F.try_divide(page_height - y - height, page_height), "width": F.try_divide(width, page_width), "height": F.try_divide(height, page_height)}
    return F.struct(*(unit(v).alias(k) for k, v in parts.items()), F.lit("normalized").alias("coordinate_system"))


def normalized_if_needed(bbox: Column, page_width: Column, page_height: Column) -> Column:
    return F.when(bbox["coordinate_system"] == "normalized", bbox).otherwise(normalized(bbox["x"], bbox["y"], bbox["width"], bbox["height"], page_width, page_height))


def quad_normalized(x1: Column, y1: Column, x2: Column, y2: Column, width_px: Column, height_px: Column, page_width: Column, page_height: Column) -> Column:
    """Extremes of four corners in pixels (y downwards) to a normalised box."""
    left, right = F.try_divide(x1, width_px) * page_width, F.try_divide(x2, width_px) * page_width
    top, bottom = F.try_divide(y1, height_px) * page_height, F.try_divide(y2, height_px) * page_height
    return normalized(left, page_height - bottom, right - left, bottom - top, page_width, page_height)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for different coordinate systems or no intersection."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    common = w * h
    union = a["width"] * a["height"] + b["width"] * b["height"] - common
    return F.when((a["coordinate_system"] == b["coordinate_system"]) & (common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))
