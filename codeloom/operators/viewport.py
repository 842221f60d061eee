"""Samples of a viewport from stored places (G19): what view.visible_nodes gives, from tables that a box reads parts of.

The index is four tables beside each other. `places` holds nodes with their places
along a curve that halves the plane by turns (Morton order), entry points apart, so a
box is a few ranges of keys and row groups outside them are passed over. `line` holds
the same nodes by number, in blocks of consecutive ones. `counts` holds how many nodes
of a block, and entry points among them, lie in each coarse cell: the counts of cells
inside a box and the places in cells on its border tell at which positions a block
begins among all nodes in the box. So far out, where every step-th node is shown, only
blocks that hold such a node are read. `bounds` holds the corner and scale of the cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import view
from codeloom.operators.build import ordered
from codeloom.plans import loops

#: Halvings of each axis, of these those of coarse cells; nodes of a block; ranges of a box, at most; bytes of a row group, about.
BITS, COARSE, BLOCK, RANGES, ROW_GROUP = 16, 6, 1 << 16, 32, 4 << 20
_LAST = (1 << BITS) - 1
#: The tables that may be empty, or partitioned, as they are read.
SCHEMAS = {"places": "ord long, kind string, x double, y double, cx long, cy long, key long, block long, entry boolean", "line": "ord long, kind string, entry boolean, x double, y double, cx long, cy long, key long, block long"}
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _cell(value: Column, low: float, scale: float) -> Column:
    """Cell along an axis; never falls as value rises, so what lies between two cells lies between the values."""
    at = (value.cast("double") - F.lit(low)) * F.lit(scale)
    return F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(float(_LAST)))).cast("long")


def _cell_of(value: float, low: float, scale: float) -> int:
    return math.floor(min(max((value - low) * scale, 0.0), float(_LAST)))


def morton(x: Column, y: Column) -> Column:
    """The bits of two cells by turns."""

    def spread(c: Column) -> Column:
        for shift, mask in _SPREAD:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def ranges(x0: int, x1: int, y0: int, y1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, at most about `most`, that cover all cells of a box: quarters are cut, the largest first, while they are partly outside."""
    open_, done = [(BITS, 0, 0, 0)], []  # (bits of the side, x, y, first key)
    while open_:
        bits, x, y, key = open_.pop(0)
        side = 1 << bits
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            continue
        whole = x >= x0 and y >= y0 and x + side - 1 <= x1 and y + side - 1 <= y1
        if whole or bits == 0 or len(open_) + len(done) >= most:
            done.append((key, key + (1 << 2 * bits) - 1))
        else:
            half, quarter = side >> 1, 1 << 2 * (bits - 1)
            open_ += [(bits - 1, x + half * (i & 1), y + half * (i >> 1), key + quarter * i) for i in range(4)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class PlaceIndex:
    """The index at a path, of the nodes and the places (ord, x, y; one a node) that it was written from."""

    def __init__(self, path: str):
        self.path = path

    def write(self, nodes: DataFrame, positions: DataFrame, block: int = BLOCK, row_group: int = ROW_GROUP) -> None:
        """Nodes without a place, or with a part of it that is no number, are in no box."""
        placed = nodes.select("ord", "kind", F.coalesce(F.col("metadata.is_entry_point"), F.lit(False)).alias("entry")).join(positions.select("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "ord")
        placed = placed.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
        finite = [F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)) for c in ("x", "y")]
        box = placed.agg(*[f(c) for c in finite for f in (F.min, F.max)]).first()
        corner = []
        for low, high in (box[:2], box[2:]):
            width = (high - low) if low is not None else 0.0
            scale = (1 << BITS) / width if width > 0 else 1.0
            corner += [low or 0.0, scale if math.isfinite(scale) and scale > 0 else 1.0]

        def put(df: DataFrame, table: str, *order: str, by: str | None = None) -> None:
            out = df.repartitionByRange(*order).sortWithinPartitions(*([by] if by else []), *order).write.mode("overwrite").option("parquet.block.size", row_group)
            (out.partitionBy(by) if by else out).parquet(f"{self.path}/{table}")

        cells = placed.withColumn("cx", _cell(F.col("x"), *corner[:2])).withColumn("cy", _cell(F.col("y"), *corner[2:]))
        cells = cells.withColumn("key", morton(F.col("cx"), F.col("cy"))).withColumn("block", F.floor(F.col("ord") / block).cast("long"))
        cells = loops.saved(cells, "cells")
        put(cells, "places", "key", "ord", by="entry")
        put(cells, "line", "block", "ord")
        coarse = [F.shiftright(c, BITS - COARSE).alias(c) for c in ("cx", "cy")]
        put(cells.groupBy("block", *coarse).agg(F.count("*").alias("n"), F.count(F.when(F.col("entry"), 1)).alias("entries")), "counts", "cx", "cy", "block")
        bounds = [(*corner, block)]
        nodes.sparkSession.createDataFrame(bounds, "x double, x_scale double, y double, y_scale double, block long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")
        loops.discard(cells)

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
        return reader.parquet(f"{self.path}/{table}")

    def inside(self, spark: SparkSession, box: list[float]) -> DataFrame:
        """Rows of `places` in a box [x, y, width, height], its edges included."""
        x, y, width, height = box
        cells = self._corners(spark, box)
        keys = F.lit(False)
        for a, b in ranges(*cells) if cells else ():
            keys = keys | F.col("key").between(a, b)
        return self._read(spark, "places").filter(keys).filter(F.col("x").between(x, x + width) & F.col("y").between(y, y + height))

    def _corners(self, spark: SparkSession, box: list[float]) -> tuple[int, int, int, int] | None:
        """First and last cell of a box on either axis; None for a box that holds nothing, as one whose edges are no numbers."""
        x, y, width, height = box
        if any(math.isnan(v) for v in (x, y, x + width, y + height)) or width < 0 or height < 0:
            return None
        bounds = self._read(spark, "bounds").first()
        at = (bounds["x"], bounds["x_scale"]), (bounds["y"], bounds["y_scale"])
        return _cell_of(x, *at[0]), _cell_of(x + width, *at[0]), _cell_of(y, *at[1]), _cell_of(y + height, *at[1])

    def blocks(self, spark: SparkSession, box: list[float]) -> DataFrame:
        """(block, n, entries): nodes in a box by block; from counts in cells that lie inside, from places on its border alone."""
        cells = self._corners(spark, box)
        x0, x1, y0, y1 = (c >> (BITS - COARSE) for c in cells) if cells else (0, 0, 0, 0)
        within = F.col("cx").between(x0 + 1, x1 - 1) & F.col("cy").between(y0 + 1, y1 - 1)
        whole = self._read(spark, "counts").filter(within).select("block", "n", "entries")
        size = 1 << (BITS - COARSE)
        border = self.inside(spark, box).filter(~(F.col("cx").between((x0 + 1) * size, x1 * size - 1) & F.col("cy").between((y0 + 1) * size, y1 * size - 1)))
        if cells and x1 - x0 > 1 and y1 - y0 > 1:  # four sides, each some ranges of keys
            sides = [(cells[0], cells[1], cells[2], (y0 + 1) * size - 1), (cells[0], cells[1], y1 * size, cells[3]), (cells[0], (x0 + 1) * size - 1, (y0 + 1) * size, y1 * size - 1), (x1 * size, cells[1], (y0 + 1) * size, y1 * size - 1)]
            keys = F.lit(False)
            for side in sides:
                for a, b in ranges(*side):
                    keys = keys | F.col("key").between(a, b)
            border = border.filter(keys)
        edge = border.select("block", F.lit(1).cast("long").alias("n"), F.col("entry").cast("long").alias("entries"))
        return whole.unionByName(edge).groupBy("block").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"))

    def visible(self, spark: SparkSession, viewport: list[float]) -> DataFrame:
        """(ord, place) of the nodes to draw in a viewport [x, y, width, height, zoom], as view.visible_nodes gives them."""
        *box, zoom = viewport[:5]

        def numbered(df: DataFrame, *by: str) -> DataFrame:
            places = ordered(df.withColumnRenamed("ord", "_ord"), *["_ord" if b == "ord" else b for b in by])
            return places.select(F.col("_ord").alias("ord"), (F.col("ord") + 1).cast("int").alias("place"))

        near = self.inside(spark, box)
        if zoom >= view.FULL_ZOOM:
            return numbered(near.select("ord"), "ord")
        if zoom >= view.FAR_ZOOM:
            return numbered(near.filter(F.col("kind") != "Function").select("ord"), "ord")
        with loops.scope() as kept:
            blocks = loops.saved(self.blocks(spark, box), "blocks")  # a row per block
            n, entries = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
            if n <= view.FAR_MOST:
                return loops.result(numbered(near.select("ord"), "ord"), kept, "visible")
            room = view.FAR_MOST - entries
            shown = near.filter(F.col("entry")).select("ord", F.lit(0).alias("_kind"))
            if room > 0:
                step = max(1, n // room)
                shown = shown.unionByName(self._steps(spark, box, blocks, step).orderBy("ord").limit(room).select("ord", F.lit(1).alias("_kind")))
            return loops.result(numbered(shown, "_kind", "ord"), kept, "visible")

    def _steps(self, spark: SparkSession, box: list[float], blocks: DataFrame, step: int) -> DataFrame:
        """(ord) of every step-th node in a box, entry points left out: reads the blocks that hold any."""
        x, y, width, height = box
        before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
        firsts = blocks.select("block", "n", before.alias("_before"))
        firsts = firsts.filter(F.floor((F.col("_before") + F.col("n") - 1) / step) * step >= F.col("_before")).select("block", "_before")
        wanted = [r["block"] for r in firsts.select("block").orderBy("block").limit(2 * view.FAR_MOST + 1).collect()]  # no more than positions shown
        line = self._read(spark, "line").filter(F.col("block").isin(wanted)) if len(wanted) <= 2 * view.FAR_MOST else self._read(spark, "line")
        rows = line.filter(F.col("x").between(x, x + width) & F.col("y").between(y, y + height)).join(F.broadcast(firsts) if len(wanted) <= 2 * view.FAR_MOST else firsts, "block")
        at = F.row_number().over(Window.partitionBy("block").orderBy("ord")) - 1 + F.col("_before")
        return rows.select("ord", "entry", at.alias("_at")).filter(~F.col("entry") & (F.col("_at") % step == 0)).select("ord")
