"""Accuracy, paired tests, resampling and judges' agreement."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as sc
from ..sources.scratch import store
from .retrieval import numbered
from .selection import hinted, percentiles


def mcnemar_counts(preds: DataFrame, arms: list[str]) -> DataFrame:
    """Paired counts for all pairs of arms in the given order, over items that both answered.

    Args:
        preds: arm, question_id, ok (true or false).

    Returns:
        arm_a, arm_b, n, a_only, b_only, delta.
    """
    place = F.array_position(F.array(*map(F.lit, arms)), F.col("arm"))
    rows = preds.select("question_id", F.struct(place.alias("k"), "arm", "ok").alias("x"))
    per = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most the arms
    pairs = per.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b")).filter("a.k < b.k")
    return pairs.groupBy(F.col("a.arm").alias("arm_a"), F.col("b.arm").alias("arm_b")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a.ok") & ~F.col("b.ok")).alias("a_only"),
        F.count_if(F.col("b.ok") & ~F.col("a.ok")).alias("b_only"),
        (F.avg(F.col("a.ok").cast("double")) - F.avg(F.col("b.ok").cast("double"))).alias("delta"),
    )


def mcnemar(counts: DataFrame, *, exact_below: int = 25) -> DataFrame:
    """The counts with statistic, p and method: exact below 25 discordant items, else chi-squared."""
    n = F.col("a_only") + F.col("b_only")
    stat = F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1, F.lit(2.0)) / F.greatest(n, F.lit(1))
    exact = n < exact_below
    p = F.when(n == 0, 1.0).when(exact, sc.sign_tail(F.least("a_only", "b_only"), F.when(exact, n).otherwise(0))).otherwise(sc.chi2_tail(stat))
    return counts.withColumns(
        {"statistic": F.when(exact, None).otherwise(stat), "p": p, "method": F.when(exact, "mcnemar-exact").otherwise("mcnemar-chi2")}
    )


#: The greatest power of two of which a draw takes a Poisson number at once, parts of the 32 bits of a
#: draw by which it is looked up, and partitions that rounds are dealt over.
POWER, SLOTS = 20, 256
PARTS = 64


def poisson_steps(power: int) -> list[tuple[int, int, int]]:
    """k, low, high: a draw of 32 bits from low up to high means k of a Poisson number of mean 2**power.

    Numbers 8 standard deviations from the mean and further are left to the outermost ones.
    """
    mean = 2.0**power
    spread = 8 * math.sqrt(mean)
    first, last = max(0, math.floor(mean - spread) - 10), math.floor(mean + spread) + 12
    shares = itertools.accumulate(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(first, last + 1))
    ends = [*(min(math.floor(x * 2**32), 2**32) for x in shares)][:-1]
    return [(k, low, high) for k, low, high in zip(range(first, last + 1), [0, *ends], [*ends, 2**32], strict=True) if low < high]


def bootstrap(values: DataFrame, *, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42, by: str = "arm") -> DataFrame:
    """Percentile bootstrap of the mean by group: by, n, mean, low, high.

    In a resample every item occurs a Poisson number of times, of mean 1, and the mean is that of what
    occurs; this is the same at all sizes. Items of an equal value (to 9 decimals) occur together as
    often as a Poisson number whose mean is their number, which is the sum of numbers for the powers of
    two in it. Each of these is looked up, by a draw from the MD5 of seed, group, value, power and
    resample, in the table of its cumulative shares. So a resample costs a few draws per distinct
    value, wherever that lies; tasks add up before the shuffle.

    Args:
        values: by, id, value. Null values count in n alone. Differences of pairs are values too.
    """
    sizes = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    nano = F.round(F.col("value").cast("double") * 1_000_000_000).cast("long")
    cells = values.filter("value is not null").groupBy(by, nano.alias("nano")).agg(F.count(F.lit(1)).alias("c"))
    # A value's number in powers of two: each bit is a part of its own, the highest power as often as needed.
    powers = F.expr(f"transform(filter(sequence(0, {POWER - 1}), p -> c >> p & 1 = 1), p -> struct(p as power, 0L as part))")
    tops = F.expr(f"transform(filter(sequence(0L, c >> {POWER}), i -> i < c >> {POWER}), i -> struct({POWER} as power, i as part))")
    parts = cells.select(by, "nano", F.inline(F.concat(powers, tops))).repartition(PARTS, by, "nano", "power", "part")
    drawn = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    drawn = drawn.withColumn("d", sc.draw("boot", F.lit(seed), F.col(by), F.col("nano"), F.col("power"), F.col("part"), F.col("b")))
    each, most = 2**32 // SLOTS, cells.agg(F.max("c")).first()[0] or 1
    steps = [
        (power, slot, *step)
        for power in range(min(most.bit_length(), POWER + 1)) for step in poisson_steps(power) for slot in range(step[1] // each, (step[2] - 1) // each + 1)
    ]
    steps = values.sparkSession.createDataFrame(steps, "power int, slot long, k long, low long, high long")  # its size is fixed
    met = drawn.withColumn("slot", F.expr(f"d div {each}")).join(F.broadcast(steps), ["power", "slot"]).filter("d >= low and d < high")
    sums = met.groupBy(by, "b").agg(F.sum(F.col("k") * F.col("nano") / 1_000_000_000).alias("s"), F.sum("k").alias("k"))
    means = sums.select(by, F.try_divide("s", "k").alias("m"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    out = sizes.alias("a").join(ends.alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")), "left")
    return out.select(f"a.{by}", "n", "mean", "low", "high")


def paired_differences(rows: DataFrame, pairs: list[tuple[str, str]], *, value: str, key: str = "question_id") -> DataFrame:
    """pair (``a - b``), arm_a, arm_b, id, d: for each pair of arms the differences of the items that both have.

    Args:
        rows: arm, key, value.
    """
    told = rows.sparkSession.createDataFrame(pairs, "arm_a string, arm_b string")
    side = lambda s: rows.select(F.col("arm").alias(f"arm_{s}"), F.col(key).alias("id"), F.col(value).alias(s))
    met = side("a").join(F.broadcast(told), "arm_a").join(side("b"), ["arm_b", "id"])
    return met.select(F.concat("arm_a", F.lit(" - "), "arm_b").alias("pair"), "arm_a", "arm_b", "id", (F.col("a") - F.col("b")).alias("d"))


def paired_intervals(diffs: DataFrame, *, resamples: int = 10_000, rounds: int = 20_000, seed: int = 42, scale: int = 1) -> DataFrame:
    """pair, arm_a, arm_b, n, delta, low, high, p, higher, lower: a bootstrap interval and a sign-flip test.

    Args:
        diffs: pair, arm_a, arm_b, id, d: multiples of 1 / scale.
    """
    ends = bootstrap(diffs.select("pair", "id", F.col("d").alias("value")), resamples=resamples, seed=seed, by="pair")
    tests = sign_flips(diffs.select("pair", "id", F.round(F.col("d") * scale).cast("long").alias("d")), rounds=rounds, seed=seed, by="pair")
    arms = diffs.groupBy("pair").agg(F.min("arm_a").alias("arm_a"), F.min("arm_b").alias("arm_b"))
    out = arms.join(ends, "pair").join(tests.drop("n", "total"), "pair")  # a row a pair each
    return out.select("pair", "arm_a", "arm_b", "n", F.col("mean").alias("delta"), "low", "high", "p", "higher", "lower")


def sign_flips(diffs: DataFrame, *, rounds: int = 20_000, seed: int = 42, by: str = "pair") -> DataFrame:
    """Sign-flip test of a mean difference of whole-number scores: by, n, total, p.

    Sums of whole numbers are compared, so that ties with the observed one are exact. Items of
    equal size are numbered in chunks of 60; in each round the MD5 of seed, group, size, chunk and
    round gives every item of a chunk its sign by a bit.

    Args:
        diffs: by, id, d (whole numbers).
    """
    cells = store(diffs.groupBy(by, "d").agg(F.count(F.lit(1)).alias("items")), "cells")  # few rows, read several times
    of = lambda which: F.coalesce(F.sum(F.when(which, F.col("items"))), F.lit(0)).alias
    seen = cells.groupBy(by).agg(F.sum("items").alias("n"), F.sum(F.col("d") * F.col("items")).alias("total"), of(F.col("d") > 0)("higher"), of(F.col("d") < 0)("lower"))
    alike = cells.filter("d != 0").groupBy(by, F.abs("d").cast("long").alias("size")).agg(F.sum("items").alias("items"))
    chunks = alike.select(by, "size", "items", F.explode(F.sequence(F.lit(0), F.expr("cast((items - 1) div 60 as int)"))).alias("chunk"))
    chunks = chunks.select(by, "size", "chunk", F.least(F.lit(60), F.col("items") - 60 * F.col("chunk")).cast("int").alias("width"))
    turns = diffs.sparkSession.range(rounds).withColumnRenamed("id", "r")
    flipped = chunks.repartition(PARTS, by, "size", "chunk").crossJoin(F.broadcast(turns))
    drawn = F.md5(F.concat_ws("|", F.lit(f"flip|{seed}"), *[F.col(c).cast("string") for c in (by, "size", "chunk", "r")]))
    bits = F.call_function("shiftright", F.conv(F.left(drawn, F.lit(15)), 16, 10).cast("long"), 60 - F.col("width"))
    sums = flipped.groupBy(by, "r").agg(F.sum(F.col("size") * (2 * F.bit_count(bits) - F.col("width"))).alias("s"))
    far = sums.join(seen, by).groupBy(by).agg(F.count_if(F.abs("s") >= F.abs("total")).alias("far"))
    # Without any difference every round ties with the observed sum of 0.
    out = seen.join(far, by, "left")
    return out.select(by, "n", "total", "higher", "lower", ((F.coalesce("far", F.lit(rounds)) + 1) / (rounds + 1)).alias("p"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of (human, machine) grades: n, exact, kappa."""
    cells = pairs.groupBy("human", "machine").agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("human") == F.col("machine"), F.col("c")).otherwise(0)).alias("same"))
    a = cells.groupBy("human").agg(F.sum("c").alias("x"))
    b = cells.groupBy("machine").agg(F.sum("c").alias("y"))
    chance = a.join(b, F.col("human") == F.col("machine")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    rows = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    value = F.when(pe >= 1, 0.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return rows.select("n", po.alias("exact"), value.alias("kappa"))


def latency_summary(samples: DataFrame, *, warmup: int = 3, by: str = "arm") -> DataFrame:
    """Percentiles of seconds (by, seq, seconds), without the first of each group by sequence.

    The first are cut at the sequence of the last of them, of which tasks hand on a few a group; samples
    of an equal sequence are one for this. Percentiles are exact, found by histograms, so that a
    large group is in no task.
    """
    if warmup:
        place = F.row_number().over(W.partitionBy(by).orderBy("seq"))
        first = samples.select(by, "seq").withColumn("place", place).filter(F.col("place") <= warmup)
        cut = hinted(store(first.groupBy(F.col(by).alias("__g")).agg(F.max("seq").alias("__cut")), "cut"))
        samples = samples.join(cut, F.col(by).eqNullSafe(F.col("__g"))).filter("seq > __cut").drop("__g", "__cut")
    told = percentiles(samples, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=by, value="seconds").drop("n")
    rest = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    met = rest.alias("a").join(told.alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")), "left")
    return met.select(f"a.{by}", "n", "p50", "p95", "p99", "mean", "min", "max")


def position_bias(rows: DataFrame, *, n_options: int = 4, by: str = "arm") -> DataFrame:
    """Rates of each place among predictions and gold, nulls apart, and the greatest excess."""
    aggs = []
    for kind in ("predicted_idx", "answer_idx"):
        n = F.greatest(F.count(kind), F.lit(1))
        aggs += [(F.count_if(F.col(kind) == i) / n).alias(f"{kind}_{i}") for i in range(n_options)]
    out = rows.groupBy(by).agg(*aggs)
    excess = [F.abs(F.col(f"predicted_idx_{i}") - F.col(f"answer_idx_{i}")) for i in range(n_options)]
    return out.withColumn("max_excess", F.greatest(*excess))


def cyclic_next(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Rows with ``control``: the next row's value in the order; the last gets the first's."""
    rows = numbered(rows, order)
    n = rows.count()
    ahead = rows.select(F.pmod(F.col("index") - 1, F.lit(max(n, 1))).alias("index"), F.col(column).alias("control"))
    return rows.join(ahead, "index").drop("index")


def reference_run(runs: DataFrame, *, seed: int = 42, by: str = "arm") -> DataFrame:
    """Of each arm the run of the reference seed, else its only run; several others are an error."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    has = F.max((F.col("seed") == seed).cast("int")).over(W.partitionBy(by))
    bad = F.raise_error(F.concat(F.lit("no reference run of "), F.col(by))).cast("boolean")
    pick = F.when(has == 1, F.col("seed") == seed).when(n == 1, True).otherwise(bad)
    return runs.withColumn("__pick", pick).filter("__pick").drop("__pick")
