"""Clean-up of detections (P16, P17, W13) as joins over boxes: no frame is folded as one array.

Boxes are rows (frame_id, label, bbox [x1, y1, x2, y2], conf).  Overlapping pairs meet in a grid hash: a box lies in cells as large as itself, at most four, and
in the coarser cells of boxes that may still overlap it enough.  Suppression then goes in rounds over the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions.media import iou, tile_starts
from shotline.operators.search import materialize


def tiles(frames: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """(frame_id, width, height) -> (frame_id, x, y): corners of the tiles that cover each frame."""
    x = frames.select("frame_id", "height", F.explode(tile_starts(F.col("width"), tile, overlap)).alias("x"))
    return x.select("frame_id", "x", F.explode(tile_starts(F.col("height"), tile, overlap)).alias("y"))


def placed(found: DataFrame) -> DataFrame:
    """Boxes found in a region or tile (frame_id, x, y, label, bbox, conf) in the coordinates of their frames."""
    b = F.col("bbox")
    return found.select("frame_id", "label", F.array(b[0] + F.col("x"), b[1] + F.col("y"), b[2] + F.col("x"), b[3] + F.col("y")).alias("bbox"), "conf")


def overlapping(boxes: DataFrame, least: float, by_label: bool) -> DataFrame:
    """(id, better): for each box (id, place, frame_id, label, bbox) those of smaller place in its frame, and of its label, whose overlap with it is at least least.

    A pair meets at the level of its larger box, in the one cell where its intersection begins.  With an overlap of least sides differ by a factor
    of 1 / least at most, so a box has to visit few levels above its own.
    """
    b = F.col("bbox")
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    level = F.ceil(F.log2(F.greatest(side, F.lit(1e-6)))).cast("int")
    above = math.ceil(math.log2(1 / least)) + 1
    key = ["frame_id", *(["label"] if by_label else [])]
    rows = boxes.filter(F.forall(b, lambda x: F.coalesce(~F.isnan(x), F.lit(False))) & (F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]))
    rows = rows.select(*key, "id", "place", "bbox", level.alias("own")).withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + above)))
    size = F.pow(F.lit(2.0), F.col("level"))
    cells = lambda a, z: F.explode(F.sequence(F.floor(b[a] / size), F.floor(b[z] / size)))
    rows = rows.withColumn("cx", cells(0, 2)).withColumn("cy", cells(1, 3))
    cell = [*key, "level", "cx", "cy"]
    other = rows.select(*cell, F.col("id").alias("better"), F.col("place").alias("p"), F.col("bbox").alias("o"), F.col("own").alias("q"))
    pairs = rows.join(other, cell).filter((F.col("p") < F.col("place")) & (F.greatest("own", "q") == F.col("level")))
    first = lambda k, c: F.floor(F.greatest(b[k], F.col("o")[k]) / size) == F.col(c)
    return pairs.filter(first(0, "cx") & first(1, "cy") & (iou(b, F.col("o")) >= least)).select("id", "better")


def suppress(boxes: DataFrame, most: float = 0.5, by_label: bool = True) -> DataFrame:
    """Boxes (frame_id, label, bbox, conf) that greedy suppression keeps: the surest first, ties by label and box; what overlaps a kept one by most or more goes.

    In each round a box whose better neighbours have all gone stays, and the neighbours behind it go; that is what taking them one by one
    gives.  Boxes without area, or with sides that aren't numbers, overlap nothing and stay.  by_label: other labels don't matter.
    """
    if not 0 < most <= 1:
        raise ValueError("most has to be above 0 and at most 1")
    columns = ["frame_id", "label", "bbox", "conf"]
    rows = materialize(boxes.select(*columns).withColumn("id", F.monotonically_increasing_id()))
    order: Column = F.struct((-F.col("conf")).alias("k"), F.col("label"), F.col("bbox"), F.col("id"))
    pairs = materialize(overlapping(rows.withColumn("place", order), most, by_label))
    gone = pairs.select("id").limit(0)
    open_pairs = pairs
    while True:
        waiting = open_pairs.select("id").distinct()
        # better ones that wait for nothing themselves stay, so what is behind them goes
        out = materialize(open_pairs.join(waiting.withColumnRenamed("id", "better"), "better", "left_anti").select("id").distinct())
        if out.isEmpty():
            break
        gone = gone.unionByName(out)
        left = open_pairs.join(out, "id", "left_anti").join(out.withColumnRenamed("id", "better"), "better", "left_anti")
        open_pairs = materialize(left.select("id", "better"))
    return rows.join(gone, "id", "left_anti").select(*columns)
