"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import hinted, store, uniform, words

#: Cells that one round of the search for a source's cut divides a range into.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float, cap: float) -> DataFrame:
    """Share all words among the sources by weight.

    Sources go by code point, null last, and weigh the given weights in turn. A target stops
    at cap times its source's size; the excess goes to the others by weight until none is
    above. In the order of size over weight, the capped sources come first; so one running sum
    finds the level at which the others stand.

    Returns:
        source, source_size, target.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select("*", (F.row_number().over(place) - 1).alias("k"))
    per = per.select("*", F.get(cycle, (F.col("k") % len(weights)).cast("int")).alias("weight"))
    ranked = W.orderBy(F.col("source_size") / F.col("weight"), "k")
    everywhere = W.partitionBy(F.lit(0))
    per = per.select(
        "*",
        (F.sum("source_size").over(everywhere) * F.lit(float(total_share))).alias("all_words"),
        F.coalesce(F.sum(F.col("source_size") * F.lit(float(cap))).over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(ranked.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
    )
    per = per.withColumn("level", F.greatest(F.col("all_words") - F.col("full"), F.lit(0.0)) / F.col("rest"))
    below = F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(cap))
    per = per.withColumn("fair", F.min(F.when(below, F.struct(F.col("source_size") / F.col("weight"), "k", "level"))).over(everywhere)["level"])
    limit = F.col("source_size") * F.lit(float(cap))
    target = F.when(F.col("fair").isNull(), limit).otherwise(F.least(limit, F.col("fair") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def inclusion_weight(size: Column) -> Column:
    """The weight of a document's expected copies: long ones count more, by the square root."""
    return F.sqrt(size.cast("double"))


def _odds_rank(size: Column, doc_id: Column, share: Column, seed: int) -> Column:
    """Pareto's rank u/(1-u) : p/(1-p), mapped from (0, inf) to (0, 1); p = 0 ranks last."""
    u, p = uniform(doc_id, size, seed=seed), F.when((share > 0) & (share < 1), share)
    q = (u / (1 - u)) / (p / (1 - p))
    return F.coalesce(q / (1 + q), F.lit(1.0))


def mixing_plan(
    sizes: DataFrame,
    *,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    total_share: float = 1.0,
    cap: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """Find what each source's documents need to decide for themselves.

    The expected copies of a document are scale * weight(size), at most cap, with the scale of
    its source chosen so that the expected words make the target. Whole copies are certain;
    the rest is its probability of one more. Documents rank by random odds over inclusion
    odds, and those of least rank are taken until the words they still owe the target are
    reached as nearly as whole documents allow. The cut is found by two rounds of histograms
    of the ranks and a look at one cell in CELLS**2, so that no task sorts a source.

    Args:
        sizes: doc_id, source, size, one row per document.

    Returns:
        source, source_size, target, scale, cut, cut_id: a row per source.
    """
    targets = source_targets(sizes, weights, total_share, cap)
    by_size = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = _with(by_size, store(targets, "targets"))
    down = W.partitionBy("source").orderBy(F.col("size").desc())
    mass = F.col("size") * F.col("n")
    walked = by_size.select(
        "*",
        F.coalesce(F.sum(mass * F.lit(float(cap))).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum(mass * inclusion_weight(F.col("size"))).over(down.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
    )
    walked = walked.withColumn("scale", F.try_divide(F.col("target") - F.col("full"), F.col("rest")))
    fits = (F.col("rest") > 0) & (F.col("scale") * inclusion_weight(F.col("size")) <= F.lit(float(cap)) * (1 + 1e-12))
    # Where all are capped there is no scale; then every document has cap copies.
    scales = walked.groupBy("source", "source_size", "target").agg(
        F.max_by(F.greatest("scale", F.lit(0.0)), F.when(fits, F.col("size"))).alias("scale")
    )
    scales = store(scales, "scales")
    ranked = _with(sizes, scales.select("source", "scale"))
    extra, whole = _copies(F.col("size"), F.col("scale"), cap)
    ranked = ranked.select(
        "source", "doc_id", "size", (whole * F.col("size")).alias("sure"), (extra * F.col("size")).alias("owed"),
        _odds_rank(F.col("size"), F.col("doc_id"), extra, seed).alias("x"), extra.alias("extra"),
    )
    sure = _with(scales, ranked.groupBy("source").agg(F.sum("sure").alias("sure")))
    open_ = ranked.filter("extra > 0 and size > 0").withColumn("c1", F.floor(F.col("x") * CELLS))
    cells = open_.groupBy("source", "c1").agg(F.sum("size").alias("words"))
    first = store(_cut_cell(_with(cells, sure.select("source", (F.col("target") - F.col("sure")).alias("left"))), "c1"), "cells")
    inner = _with(open_, first.select("source", F.col("c1").alias("at"), "left"))
    inner = inner.filter("c1 = at").withColumn("c2", F.floor((F.col("x") * CELLS - F.col("c1")) * CELLS))
    second = store(
        _cut_cell(inner.groupBy("source", "left", "c2").agg(F.sum("size").alias("words")), "c2"), "inner_cells"
    )
    last = _with(inner.drop("left"), second.select("source", F.col("c2").alias("at2"), "left")).filter("c2 = at2")
    up = W.partitionBy("source").orderBy("x", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("size").over(up), F.lit(0)))
    cut = (
        last.filter(F.col("before") + F.col("size") / 2 <= F.col("left"))
        .groupBy("source")
        .agg(F.max(F.struct("x", "doc_id")).alias("cut"))
    )
    # Without a document of its own the cut lies at the lower bound of the cell.
    floor = _with(first.select("source", "c1"), second.select("source", "c2"))
    floor = floor.select("source", ((F.col("c1") + F.coalesce(F.col("c2"), F.lit(0)) / CELLS) / CELLS).alias("floor"))
    plan = _with(_with(scales, floor), cut)
    return store(
        plan.select(
            "source", "source_size", "target", "scale",
            F.coalesce("cut.x", "floor", F.lit(-1.0)).alias("cut"), F.col("cut.doc_id").alias("cut_id"),
        ),
        "plan",
    )


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, where null equals null; few sources are broadcast."""
    right = hinted(right).withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _copies(size: Column, scale: Column, cap: float) -> tuple[Column, Column]:
    """A document's share of one more copy, and its certain copies."""
    expected = F.least(F.coalesce(scale * inclusion_weight(size), F.lit(float(cap))), F.lit(float(cap)))
    whole = F.floor(expected + F.lit(1e-9))
    return F.greatest(expected - whole, F.lit(0.0)), whole


def _cut_cell(cells: DataFrame, cell: str) -> DataFrame:
    """The first cell of each source whose words reach what is left, and what is left for it."""
    up = W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("sum", F.sum("words").over(up))
    return (
        cells.filter("sum >= left")
        .groupBy("source")
        .agg(F.min(F.struct(cell, (F.col("left") - F.col("sum") + F.col("words")).alias("left"))).alias("at"))
        .select("source", f"at.{cell}", "at.left")
    )


def copies_taken(plan_row: dict[str, Column], size: Column, doc_id: Column, *, cap: float = 3.0, seed: int = 17) -> Column:
    """How many copies of a document the mix takes, from its source's row of the plan."""
    extra, whole = _copies(size, plan_row["scale"], cap)
    x = _odds_rank(size, doc_id, extra, seed)
    cut, cut_id = plan_row["cut"], plan_row["cut_id"]
    more = (extra > 0) & ((x < cut) | ((x == cut) & F.coalesce(doc_id <= cut_id, doc_id.isNull() & cut_id.isNull(), F.lit(True))))
    return (whole + F.when(more, 1).otherwise(0)).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text; null has none) of every document."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Decide how often the mix takes every document.

    Options are those of ``mixing_plan``. Rows of one id, source and size share a decision.
    Empty texts have size 0 and nothing is taken of them. Null sources are a source of their
    own. Reruns agree: the draws are functions of seed, id and size. An empty table gives an
    empty one.

    Returns:
        doc_id, size, source_size, target, taken, copies: a row per input row.
    """
    sizes = store(document_sizes(docs), "sizes")
    plan = mixing_plan(sizes, **options)
    rows = _with(sizes, plan)
    given = {k: options[k] for k in ("cap", "seed") if k in options}
    copies = copies_taken({k: F.col(k) for k in ("scale", "cut", "cut_id")}, F.col("size"), F.col("doc_id"), **given)
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of docs."""
    plan = mixing_plan(store(document_sizes(docs), "sizes"), **options)
    names = {c: f"__skein_{c}" for c in plan.columns}
    plan = hinted(plan.withColumnsRenamed(names))
    n, copy = "__skein_words", "__skein_copy"
    sized = docs.withColumn(n, F.size(words(docs["text"])).cast("long"))  # once: it is used at many places below
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col(names["source"])), "left")
    given = {k: options[k] for k in ("cap", "seed") if k in options}
    row = {k: F.col(names[k]) for k in ("scale", "cut", "cut_id")}
    copies = F.when(F.col(n) > 0, copies_taken(row, F.col(n), F.col("doc_id"), **given)).otherwise(0)
    out = rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return out.drop(n, copy, *names.values())
