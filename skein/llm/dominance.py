"""Dominance counts of weighted points over a quantile grid with a summed-area table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.retrieval import numbered
from .common import store

#: Distinct points of a cell of the grid on average. With d distinct points the grid has d / LOAD
#: cells, and a row or column of it sqrt(d * LOAD) points.
LOAD = 64

#: Points that a task sweeps at once; a larger strip is swept by itself.
SWEPT = 1 << 18


def sums_above(group: np.ndarray, x: np.ndarray, y: np.ndarray, weights: list[np.ndarray], strict: bool) -> list[np.ndarray]:
    """For every point the weights of its group's points with an x up to its own and a greater y.

    If strict, the others' x must be smaller. Points of a group differ in x or y. Points are
    put in order of x, so that those to count come earlier, and then halved again and again: what
    a half adds to the half after it is a running sum in descending order of y.
    """
    n = len(x)
    place = np.empty(n, np.int64)
    place[np.lexsort((y if strict else _descending(y), x, group))] = np.arange(n)
    # Descending y, equal ones from the last place on, so that none counts another of the same y.
    now = place[np.lexsort((place, y, group))[::-1]]
    sums = [np.zeros(n, w.dtype) for w in weights]
    held = [np.empty_like(w) for w in weights]
    for h, w in zip(held, weights, strict=True):
        h[place] = w
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        right = (now >> bit) & 1 == 1
        start = now >> (bit + 1) << (bit + 1)
        left = np.concatenate(([0], np.cumsum(~right)))
        for s, h in zip(sums, held, strict=True):
            run = np.concatenate(([0], np.cumsum(np.where(right, 0, h[now]))))
            s[now[right]] += (run[:-1] - run[start])[right]
        lefts = left[:-1] - left[start]
        at = start + np.where(right, (1 << bit) + np.arange(n) - start - lefts, lefts)
        later = np.empty_like(now)
        later[at] = now
        now = later
    return [s[place] for s in sums]


def _descending(y: np.ndarray) -> np.ndarray:
    """Numbers in the opposite order of y, of any type."""
    return -np.unique(y, return_inverse=True)[1]


def _swept(points: DataFrame, *, group: list[str], x: str, y: str, strict: bool) -> DataFrame:
    """The points with their sums n and m over those of their group that count, group by group.

    Groups are dealt out whole; a task sweeps as many as make up ``SWEPT`` points at a time.
    """
    rows = points.select(*group, x, y, "n", "m").repartition(*group).sortWithinPartitions(*group)
    at = {name: k for k, name in enumerate(rows.columns)}

    def sums(batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        of = lambda name: batch.column(at[name]).to_numpy()
        changes = np.any([np.diff(of(g), prepend=-1) != 0 for g in group], axis=0)
        n, m = sums_above(np.cumsum(changes), of(x), of(y), [of("n"), of("m")], strict)
        columns = [*(batch.column(at[c]).combine_chunks() for c in (*group, x, y)), pa.array(n), pa.array(m)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SWEPT:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(at[g])[-1] for g in group]
            same = np.all([table.column(at[g]).to_numpy() == v.as_py() for g, v in zip(group, last, strict=True)], axis=0)
            whole = int(np.argmax(same))  # the last group may go on in the next batch
            if whole:
                yield sums(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield sums(pa.Table.from_batches(held))

    return rows.mapInArrow(made, rows.schema)


def _bands(points: DataFrame, column: str, name: str, bands: int, total: int) -> DataFrame:
    """The values of a column with the band of quantiles that each begins in; a frequent value may span several."""
    values = numbered(points.groupBy(column).agg(F.count(F.lit(1)).alias("w")), column, weight="w")
    return values.select(column, F.expr(f"cast(before * {bands} div {total} as long)").alias(name))


def _whole_cells(cells: DataFrame) -> DataFrame:
    """The summed-area table at every cell (row, col): n and m of all cells of earlier rows and later columns.

    Along a row sums run from the last column; between its cells they stay the same, and are
    spelt out there. Along a column they run from the first row.
    """
    down = W.partitionBy("row").orderBy(F.col("col").desc())
    sums = [F.sum(c).over(down.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in "nm"]
    along = cells.select("row", "col", F.lead("col", 1, 0).over(down).alias("next"), *sums).filter("next < col")
    along = along.select("row", F.explode(F.sequence("next", F.col("col") - 1)).alias("col"), "n", "m", F.lit(False).alias("asked"))
    asked = cells.select("row", "col", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("asked"))
    before = W.partitionBy("col").orderBy("row").rangeBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "nm"]
    return along.unionByName(asked).select("row", "col", *sums, "asked").filter("asked").drop("asked")


def count_above(rows: DataFrame, *, slot: str = "slot", level: str = "level", weight: str | None = None, load: int = LOAD) -> DataFrame:
    """Count for every row the rows above it: of a slot up to its own and a strictly larger level.

    Rows first add up to distinct points, before a shuffle. Quantiles of slots and levels cut the
    plane into a grid; the points above a point then lie

    * in whole cells of earlier rows and later columns of the grid: from a suffix summed-area table,
    * in its own grid row, up to its slot, in later columns: that row strip is swept, with the
      points of a slot and column added up,
    * in its own column of the grid, of larger level, in earlier rows: that column strip, likewise,
    * in its own cell: swept.

    So a strip holds about sqrt(load x distinct points), a frequent slot or level included, as its
    points are added up by the other axis' bands. Quantiles come from ranges that are sorted and
    numbered apart; nothing is collected or broadcast that grows with the rows. Where the counts
    meet the rows, a frequent point is a skewed join that the planner splits.

    Args:
        rows: slot and level, whole or floating numbers, and a weight, a whole number (1 if none).

    Returns:
        all columns of rows, then n_above, and weight_above, the weights of those (long). Rows
        without slot or level are above none, and have null counts. Rows that repeat are each
        counted, by others and never by one another, as their level isn't larger. A null weight
        is 0. NaN is the greatest number. An empty table gives an empty one. Columns of rows named
        n_above or weight_above are refused; other names are free.
    """
    if clash := {"n_above", "weight_above"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    told = rows.select(F.col(slot).alias("slot"), F.col(level).alias("level"), w.cast("long").alias("w")).filter("slot is not null and level is not null")
    points = store(told.groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("m")), "points")
    total = points.count()
    bands = max(1, math.ceil(math.sqrt(total / load)))
    placed = points.join(_bands(points, "slot", "row", bands, max(total, 1)), "slot")
    placed = store(placed.join(_bands(points, "level", "col", bands, max(total, 1)), "level"), "placed")
    added = [F.sum(c).alias(c) for c in "nm"]
    in_row = _swept(placed.groupBy("row", "slot", "col").agg(*added), group=["row"], x="slot", y="col", strict=False)
    in_col = _swept(placed.groupBy("col", "row", "level").agg(*added), group=["col"], x="row", y="level", strict=True)
    in_cell = _swept(placed, group=["row", "col"], x="slot", y="level", strict=False)
    whole = _whole_cells(placed.groupBy("row", "col").agg(*added))
    named = lambda df, k: df.withColumnsRenamed({"n": f"n{k}", "m": f"m{k}"})
    found = named(in_cell, 0).join(named(whole, 1), ["row", "col"]).join(named(in_row, 2), ["row", "col", "slot"]).join(named(in_col, 3), ["row", "col", "level"])
    sums = [sum((F.col(f"{c}{k}") for k in range(1, 4)), F.col(f"{c}0")).alias(name) for c, name in (("n", "n_above"), ("m", "weight_above"))]
    found = store(found.select(F.col("slot").alias("__slot"), F.col("level").alias("__level"), *sums), "above")
    met = (F.col(slot) == F.col("__slot")) & (F.col(level) == F.col("__level"))
    return rows.join(found, met, "left").drop("__slot", "__level")
