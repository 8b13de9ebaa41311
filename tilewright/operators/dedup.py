"""Cells seen by several windows: which to keep.

Order decides ties everywhere: safe cells first, then seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .components import components


def retain_border(cells: DataFrame, slide: str = "slide", all_tiles: bool = False) -> DataFrame:
    """Drop edge cells whose first neighbour window has cells of its own outside the margin (all_tiles: any cells), and those without
    a neighbour. Safe and margin cells stay."""
    first = F.get("border_tiles", F.lit(0))
    border = cells.where("NOT safe AND touching").withColumns({"_c": first["col"], "_r": first["row"]}).where("_c IS NOT NULL")
    rivals = (cells if all_tiles else cells.where("NOT safe")).select(F.col(slide).alias("_s"), F.col("icol").alias("_ic"), F.col("irow").alias("_ir")).distinct()
    kept = border.join(rivals, (F.col(slide) == F.col("_s")) & (F.col("_c") == F.col("_ic")) & (F.col("_r") == F.col("_ir")), "left_anti").drop("_c", "_r")
    return cells.where("safe OR NOT touching").unionByName(kept)


def keep_first(cells: DataFrame, slide: str = "slide") -> DataFrame:
    """One cell for each whole-pixel centroid: safe first, then least seq."""
    at = Window.partitionBy(slide, F.col("cx").cast("bigint"), F.col("cy").cast("bigint")).orderBy(F.desc("safe"), "seq")
    return cells.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


#: Boxes of a leaf, about; one box in SAMPLED is seen when leaves are laid out.
LEAF, SAMPLED = 256, 8
#: Boxes that are compared at once, and pairs of them.
BOXES, PAIRS = 1 << 16, 1 << 18


def _laid_out(x: np.ndarray, y: np.ndarray, leaf: int) -> list[dict]:
    """Slabs of equal numbers of the points by x, each cut into leaves of equal numbers by y; they cover the plane. Row -1 has the cuts between slabs, every other one those of its slab
    and the number of its first leaf. `steps` are the powers of two that a search through the cuts takes."""

    def row(slab: int, first: int, v: np.ndarray, n: int) -> dict:
        cuts = np.unique(np.sort(v)[np.arange(1, n) * len(v) // n]) if n > 1 else np.zeros(0)
        return {"slab": slab, "first": first, "cuts": cuts, "steps": [1 << k for k in reversed(range(len(cuts).bit_length()))]}

    side = max(1, round(np.sqrt(len(x) * SAMPLED / leaf)))
    out, first = [row(-1, 0, x, side)], 0
    of = np.searchsorted(out[0]["cuts"], x, "right")
    order = np.argsort(of, kind="stable")
    for slab, own in enumerate(np.split(y[order], np.searchsorted(of[order], np.arange(1, len(out[0]["cuts"]) + 1)))):
        out.append(row(slab, first, own, max(1, round(len(own) * SAMPLED / leaf))))
        first += len(out[-1]["cuts"]) + 1
    return out


def leaves(cells: DataFrame, slide: str = "slide", leaf: int = LEAF) -> DataFrame:
    """(slide, slab, first, cuts, steps): how each slide's plane is cut, from the corners of an eighth of its boxes, so that dense places have small leaves and empty ones large."""
    kind = cells.schema[slide].dataType.simpleString()

    def layout(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_laid_out(frame["x0"].to_numpy(float), frame["y0"].to_numpy(float), leaf)).assign(**{slide: key[0]})

    seen = cells.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLED)) == 0) if "uid" in cells.columns else cells.where(F.pmod(F.xxhash64("seq"), F.lit(SAMPLED)) == 0)
    return seen.select(slide, "x0", "y0").groupBy(slide).applyInPandas(layout, f"{slide} {kind}, slab int, first int, cuts array<double>, steps array<int>")


def _below(cuts: Column, steps: Column, value: str) -> Column:
    """How many of the cuts, sorted, are at most the value: a search by halves."""
    on = lambda at, step: (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= F.col(value))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(on(at, step), at + step).otherwise(at))


def dealt(cells: DataFrame, slide: str = "slide", leaf: int = LEAF) -> DataFrame:
    """A row for each leaf that a box reaches into: all columns, and the leaf's id and bounds (leaf, left, right, top, low). Most boxes lie in one leaf.

    A row meets the cuts between slabs first and then those of its slab only, so what it carries along is the square root of a slide's leaves.
    """
    # stored, so that its size is known: a small one is broadcast, a large one joined with slides of many boxes split
    cut = stored(leaves(cells, slide, leaf), "leaves").withColumnRenamed(slide, "_of")
    own = cells.columns

    def within(rows: DataFrame, number: str, low: str, high: str, sides: tuple[str, str]) -> DataFrame:
        """The parts from that of `low` to that of `high`, and their bounds. A slide of which no box was seen is one leaf."""
        cuts, steps = F.coalesce("cuts", F.array().cast("array<double>")), F.coalesce("steps", F.array().cast("array<int>"))
        rows = rows.withColumns({"cuts": cuts, "steps": steps})
        rows = rows.withColumns({"_from": _below(F.col("cuts"), F.col("steps"), low), "_to": _below(F.col("cuts"), F.col("steps"), high)})
        rows = rows.withColumn(number, F.explode(F.sequence("_from", F.greatest("_from", "_to"))))
        bounds = {sides[0]: F.coalesce(F.get("cuts", F.col(number) - 1), F.lit(float("-inf"))), sides[1]: F.coalesce(F.get("cuts", F.col(number)), F.lit(float("inf")))}
        return rows.withColumns(bounds).drop("_of", "slab", "cuts", "steps", "_from", "_to")

    rows = within(cells.join(cut.where("slab = -1").drop("first"), F.col(slide) == F.col("_of"), "left"), "_slab", "x0", "x1", ("leaf_left", "leaf_right"))
    rows = rows.join(cut.where("slab >= 0"), (F.col(slide) == F.col("_of")) & (F.col("_slab") == F.col("slab")), "left")
    rows = within(rows, "_leaf", "y0", "y1", ("leaf_top", "leaf_down"))
    return rows.select(*own, (F.coalesce("first", F.lit(0)) + F.col("_leaf")).alias("leaf"), "leaf_left", "leaf_right", "leaf_top", "leaf_down")


def _meeting(leaf: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes of one leaf that overlap. In the order of their left sides, a box meets those after it up to its right side."""
    n = len(leaf)
    values, rank = np.unique(np.concatenate((x0, x1)), return_inverse=True)
    start, stop = (leaf.astype(np.int64) * len(values) + r for r in (rank[:n], rank[n:]))
    order = np.argsort(start, kind="stable")
    many = np.searchsorted(start[order], stop[order]) - np.arange(n) - 1
    before = np.concatenate(([0], np.cumsum(many)))
    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(before, before[s] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(s, e), many[s:e])
        j = np.arange(before[e] - before[s]) - np.repeat(before[s:e] - before[s], many[s:e]) + i + 1
        i, j = order[i], order[j]
        met = (y0[i] < y1[j]) & (y0[j] < y1[i])
        yield i[met], j[met]
        s = e


def _pairs(rows: DataFrame, slide: str, columns: list[str]) -> DataFrame:
    """From boxes in leaves, rows of a leaf one after another, to pairs that overlap, each in the leaf of its overlap's upper left corner."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        value = {c: table[c].to_numpy() for c in ("seq", "x0", "x1", "y0", "y1", "leaf_left", "leaf_right", "leaf_top", "leaf_down")}
        for i, j in _meeting(_groups(table), *(value[c] for c in ("x0", "x1", "y0", "y1"))):
            left, top = np.maximum(value["x0"][i], value["x0"][j]), np.maximum(value["y0"][i], value["y0"][j])
            here = (left >= value["leaf_left"][i]) & (left < value["leaf_right"][i]) & (top >= value["leaf_top"][i]) & (top < value["leaf_down"][i])
            here &= value["seq"][i] != value["seq"][j]
            i, j = i[here], j[here]
            first = value["seq"][i] < value["seq"][j]
            a, b = table.select(columns).take(np.where(first, i, j)), table.select(columns).take(np.where(first, j, i))
            yield from pa.table([*a.columns, *b.columns], [f"{c}_{s}" for s in "ab" for c in columns]).combine_chunks().to_batches()

    def _groups(table: pa.Table) -> np.ndarray:
        """Leaves, numbered in their order."""
        of = table[slide].combine_chunks().dictionary_encode().indices.to_numpy(), table["leaf"].to_numpy()
        return np.concatenate(([0], np.cumsum((of[0][1:] != of[0][:-1]) | (of[1][1:] != of[1][:-1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BOXES:
                table = pa.Table.from_batches(held)
                group = _groups(table)
                whole = int(np.searchsorted(group, group[-1]))
                yield from found(table.slice(0, whole))
                # the last leaf may go on; one of very many boxes is looked at again when as many more came
                table = table.slice(whole)
                held, size = table.to_batches(), len(table) if len(table) < BOXES // 2 else 0
        if held:
            yield from found(pa.Table.from_batches(held))

    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}
    return rows.mapInArrow(run, ", ".join(f"{c}_{s} {kinds[c]}" for s in "ab" for c in columns))


def box_pairs(cells: DataFrame, leaf: int = LEAF, slide: str = "slide", least_share: float = 0.01) -> DataFrame:
    """Pairs of cells (a before b) whose boxes overlap by enough that their polygons may: every column with suffix _a and _b.

    Boxes are dealt to leaves of about as many, and those of a leaf are swept from left to right; a pair comes out only in the leaf of its overlap's upper left corner, so once.
    """
    boxes = cells.dropna(subset=[slide, "seq"]).where("x0 < x1 AND y0 < y1")
    rows = dealt(boxes, slide, leaf).repartition(slide, "leaf").sortWithinPartitions(slide, "leaf")
    pairs = _pairs(rows, slide, cells.columns)
    across, down = (F.least(f"{c}1_a", f"{c}1_b") - F.greatest(f"{c}0_a", f"{c}0_b") for c in "xy")
    return pairs.withColumn("box_area", across * down).where(F.col("box_area") >= least_share * F.least("area_a", "area_b"))


def overlap_edges(pairs: DataFrame, area: str = "box_area", least_share: float = 0.01) -> DataFrame:
    """Pairs whose common area is at least that share of either one's."""
    if not 0 < least_share <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    share = lambda s: F.col(area) / F.nullif(F.col(f"area_{s}").cast("double"), F.lit(0.0))
    return pairs.withColumns({"ratio_a": share("a"), "ratio_b": share("b")}).where((F.col("ratio_a") >= least_share) | (F.col("ratio_b") >= least_share))


def largest_of_each(cells: DataFrame, edges: DataFrame, slide: str = "slide") -> DataFrame:
    """Of every group of overlapping cells the one of largest area; ties: safe first, then least seq. Adds root, the least seq of the group. Cells are
    told apart by uid, a number of their own over all slides."""
    roots = components(edges.select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b")))
    rows = cells.join(roots.select("node", F.col("root").alias("_root")), F.col("uid") == F.col("node"), "left").drop("node")
    group = Window.partitionBy(slide, F.coalesce("_root", "uid"))
    rows = rows.withColumns({"root": F.min("seq").over(group), "_n": F.row_number().over(group.orderBy(F.desc("area"), F.desc("safe"), "seq"))})
    return rows.where("_n = 1").drop("_n", "_root", "uid")
