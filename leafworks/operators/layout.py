"""Rasters and layout boxes: content regions by expressions, ink by numpy over grey images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTENT, EDGE = ("content", "text", "table", "list"), ("header", "footer", "number", "page_number")
DARK, GAP, HEIGHT, INK, COLUMN = 140, 3, 7, 6, 2


def content_region(boxes: DataFrame) -> DataFrame:
    """``(doc, page, x0, y0, x1, y1)``: the largest content box of a page, cut where head and foot boxes lie
    inside its width and at its edges. ``boxes(doc, page, ord, label, x0, y0, x1, y1, width, height)``."""
    label = F.lower("label")
    wide = (F.col("x1") - F.col("x0") > 0.3 * F.col("width")) & (F.col("y1") - F.col("y0") > 0.15 * F.col("height"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    first = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("_a"), "ord"))
    main = boxes.filter(label.isin(*CONTENT) & wide).withColumn("_a", size).withColumn("_k", first).filter("_k = 1").drop("_k", "_a", "label", "ord")
    edge = boxes.filter(label.isin(*EDGE)).select("doc", "page", *[F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = main.join(edge, ["doc", "page"], "left").withColumn("_in", (F.col("e_x0") >= F.col("x0") - 5) & (F.col("e_x1") <= F.col("x1") + 5))
    above = F.when(F.col("_in") & (F.abs(F.col("e_y1") - F.col("y0")) < 0.06 * F.col("height")), F.col("e_y1") + 4)
    below = F.when(F.col("_in") & (F.abs(F.col("e_y0") - F.col("y1")) < 0.06 * F.col("height")), F.col("e_y0") - 4)
    out = met.groupBy("doc", "page", "x0", "y0", "x1", "y1", "width", "height").agg(F.max(above).alias("_t"), F.min(below).alias("_b"))
    clip = lambda c, low, high: F.greatest(F.lit(0), F.least(high, low)).cast("int").alias(c)
    return out.select("doc", "page", clip("x0", F.col("x0"), F.col("width")), clip("y0", F.greatest("y0", F.coalesce("_t", "y0")), F.col("height")), clip("x1", F.col("x1"), F.col("width")), clip("y1", F.least("y1", F.coalesce("_b", "y1")), F.col("height")))


def ink_ratio(grey: np.ndarray) -> float:
    """Share of pixels that are clearly dark; an image that can't be read counts as all ink."""
    return float((grey < 200).mean()) if grey.size else 1.0


def line_bands(grey: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) rows of text lines: rows with ink, merged over small gaps, high enough."""
    inked = np.flatnonzero((grey < DARK).sum(axis=1) >= INK)
    if not len(inked):
        return []
    cuts = np.flatnonzero(np.diff(inked) > GAP + 1)
    first, last = inked[np.append(0, cuts + 1)], inked[np.append(cuts, len(inked) - 1)]
    return [(int(a), int(b)) for a, b in zip(first, last) if b - a + 1 >= HEIGHT]


def left_edge(grey: np.ndarray, band: tuple[int, int]) -> int | None:
    found = np.flatnonzero((grey[band[0] : band[1] + 1] < DARK).sum(axis=0) >= COLUMN)
    return int(found[0]) if len(found) else None


def raster_rows(images: DataFrame) -> DataFrame:
    """``(doc, page, ord, y0, y1, x)`` of the text lines of ``images(doc, page, width, height, grey binary)``."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width)
                for k, band in enumerate(line_bands(grey)):
                    out.append((r.doc, r.page, k, *band, left_edge(grey, band)))
            yield pd.DataFrame(out, columns=["doc", "page", "ord", "y0", "y1", "x"])

    return images.select("doc", "page", "width", "height", "grey").mapInPandas(run, "doc string, page int, ord int, y0 int, y1 int, x double")


def page_ink(images: DataFrame) -> DataFrame:
    """``(doc, page, ink)`` of grey images; a damaged one counts as ink."""

    def run(batches):
        for batch in batches:
            ink = []
            for r in batch.itertuples():
                data = np.frombuffer(r.grey or b"", np.uint8)
                ink.append(ink_ratio(data) if data.size == r.height * r.width else 1.0)
            yield batch[["doc", "page"]].assign(ink=ink)

    return images.select("doc", "page", "width", "height", "grey").mapInPandas(run, "doc string, page int, ink double")
