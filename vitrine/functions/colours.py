"""Image colours as plain arithmetic on pixel tables: nearest names, dominant shares, blank images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of a blank image: share of white pixels, deviation of luminance, value from which a channel is white.
WHITE_SHARE, LUMINANCE_DEVIATION, WHITE = 0.985, 6.0, 245


def nearest(r: Column, g: Column, b: Column, palette: dict[str, tuple[int, int, int]]) -> Column:
    """The palette's name at the least squared distance, the first on a tie; the palette is a short literal list."""
    near = F.array(*[F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, (x, y, z)) in enumerate(palette.items())])
    return F.array_min(near)["name"]


def dominant(pixels: DataFrame, image: str, colours: int = 6, step: int = 32) -> DataFrame:
    """(image, hex, share): the commonest colours on a grid of `step`, each by its mean. pixels: image, r, g, b."""
    cell = F.struct(*[F.floor(F.col(c) / step).alias(c) for c in "rgb"])
    per = pixels.groupBy(image, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    top = per.groupBy(image).agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct("n", "r", "g", "b")), False), 1, colours).alias("top"))  # at most (256/step)^3 cells an image
    return top.select(image, "total", F.explode("top").alias("c")).select(image, F.format_string("#%02x%02x%02x", "c.r", "c.g", "c.b").alias("hex"), F.round(F.col("c.n") / F.col("total"), 4).alias("share"))


def looks_blank(pixels: DataFrame, image: str) -> DataFrame:
    """(image, blank): almost all white and hardly any contrast; images without pixels aren't in the table and count as not blank."""
    white = (F.col("r") >= WHITE) & (F.col("g") >= WHITE) & (F.col("b") >= WHITE)
    light = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return pixels.groupBy(image).agg(((F.avg(white.cast("int")) >= WHITE_SHARE) & (F.stddev_pop(light) <= LUMINANCE_DEVIATION)).alias("blank"))
