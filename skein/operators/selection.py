"""Values of given ranks, found by histograms instead of a sort: no task sees a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.scratch import scope, store

#: Bins of a round, values of one bin that are put in order at last, and rows up to which a table of a few
#: numbers a row may be broadcast.
BINS, SORTED = 1024, 10_000
BROADCAST_ROWS = 500_000


def hinted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a table for broadcast if it has few rows; larger ones are joined by shuffle."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _bin(value: Column, low: Column, high: Column, whole: bool) -> Column:
    """The bin of a value between low and high, which differ and fall into different bins."""
    if whole:
        return F.call_function("div", value - low, F.call_function("div", high - low, F.lit(BINS)) + 1)
    return F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("long")


def order_statistics(rows: DataFrame, ranks: DataFrame, *, by: str, value: str) -> DataFrame:
    """The values of given ranks in each group's ascending order, exactly.

    A round counts each group's values in bins between the least and the greatest that are still
    possible; the bin that holds the rank is the next round's range. Tasks count before the
    shuffle, and a rank costs at most ``BINS`` rows a round, whatever the size of its group. A
    round narrows the range to a 1,024th or less, until one value is left, or so few that they are sorted.

    Args:
        rows: by, value (a whole number or a double, finite; nulls are left out).
        ranks: by, rank (from 0): a rank beyond the group's values is left out.

    Returns:
        by, rank, value, before (how many values are smaller), equal (how many are the same).
    """
    kind = rows.schema[value].dataType
    whole = isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType)
    rows = rows.select(F.col(by).alias("g"), F.col(value).cast("long" if whole else "double").alias("v")).filter("v is not null")
    ends = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    asked = ranks.select(F.col(by).alias("k"), F.col("rank").cast("long").alias("rank")).distinct()
    state = ends.join(asked, F.col("g").eqNullSafe(F.col("k"))).filter("rank >= 0 and rank < n")
    with scope() as kept:
        state = store(state.select("g", "rank", "low", "high", F.lit(0).cast("long").alias("before"), "n"), "ranks")
        while True:
            n, most = state.filter("low < high").agg(F.count(F.lit(1)), F.max("n")).first()
            if not n:
                break
            open_ = hinted(state.filter("low < high").select(F.col("g").alias("k"), "rank", "low", "high", "before"), n)
            met = rows.join(open_, F.col("g").eqNullSafe(F.col("k")) & F.col("v").between(F.col("low"), F.col("high")))
            own = W.partitionBy("g", "rank")
            if most <= SORTED:
                place = F.row_number().over(own.orderBy("v")) - 1 + F.col("before")
                cells = met.withColumns({"place": place, "smaller": F.rank().over(own.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("g", "rank", "v"))})
                cells = cells.filter("place = rank").select("g", "rank", F.col("v").alias("low"), F.col("v").alias("high"), (F.col("before") + F.col("smaller")).alias("before"), "n")
            else:
                cells = met.groupBy("g", "rank", "before", _bin(F.col("v"), F.col("low"), F.col("high"), whole).alias("bin"))
                cells = cells.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
                earlier = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
                cells = cells.withColumn("before", F.col("before") + earlier).filter("rank >= before and rank < before + n")
            state = store(state.filter("low = high").unionByName(cells.select(*state.columns)), "ranks")
        kept.append(state)
    return state.select(F.col("g").alias(by), "rank", F.col("low").cast(kind).alias(value), "before", F.col("n").alias("equal"))


def percentiles(rows: DataFrame, shares: dict[str, float], *, by: str, value: str) -> DataFrame:
    """by, n and a column per name: the values at these shares, between two neighbours in proportion.

    The exact order statistics, interpolated as ``percentile`` does. Null values are left out,
    groups without others have no row.
    """
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    told = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in shares.items()])
    at = sizes.select(by, "n", F.inline(told)).withColumn("place", F.col("q") * (F.col("n") - 1))
    at = at.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    found = order_statistics(rows, at.select(by, "rank"), by=by, value=value)
    near = 1 - F.abs(F.col("place") - F.col("rank"))  # the weight of each neighbour
    met = at.alias("a").join(hinted(found).alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("a.rank") == F.col("b.rank")))
    each = [F.sum(F.when(F.col("name") == k, near * F.col(value))).alias(k) for k in shares]
    return met.select(F.col(f"a.{by}").alias(by), "n", "name", "place", F.col("a.rank").alias("rank"), value).groupBy(by, "n").agg(*each)


def smallest(rows: DataFrame, wanted: DataFrame, *, by: str, key: Column, ties: list[Column | str]) -> DataFrame:
    """The rows with ``__cut``, the place from 0 of the first of their group's cuts that they come under, or null.

    Rows are ordered by the key, a whole number, and rows of equal keys by ``ties``. A row comes under
    cut i if fewer rows than its size precede it. Each cut is a rank, sought by histograms; only
    rows that tie with a cut's key are put in order.

    Args:
        wanted: by, cuts (an array of sizes, ascending).
    """
    rows = rows.withColumn("__u", key)
    cuts = wanted.select(by, F.posexplode("cuts").alias("cut", "size"))
    found = order_statistics(rows.select(by, "__u"), cuts.select(by, (F.col("size") - 1).alias("rank")), by=by, value="__u")
    # A cut beyond the group takes all of it.
    at = cuts.alias("a").join(hinted(found).alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("a.size") - 1 == F.col("b.rank")), "left")
    at = at.select(F.col(f"a.{by}").alias("__g"), F.struct("cut", "size", F.col("b.__u").alias("u"), "before", "equal").alias("c"))
    at = at.groupBy("__g").agg(F.array_sort(F.collect_list("c")).alias("__cuts"))  # a few cuts a group
    met = rows.join(hinted(at), F.col(by).eqNullSafe(F.col("__g")), "left").drop("__g")
    under = lambda seen: F.get(F.filter("__cuts", seen), F.lit(0))["cut"]
    # A cut splits rows of an equal key if it takes some of them, not all.
    split = F.exists("__cuts", lambda c: (c["u"] == F.col("__u")) & (c["before"] + c["equal"] > c["size"]))
    clear = met.filter(~F.coalesce(split, F.lit(False)))
    clear = clear.withColumn("__cut", under(lambda c: (c["size"] > 0) & (c["u"].isNull() | (F.col("__u") <= c["u"]))))
    tied = met.filter(split).withColumn("__place", F.row_number().over(W.partitionBy(by, "__u").orderBy(*ties)) - 1)
    same = F.filter("__cuts", lambda c: c["u"] == F.col("__u"))
    tied = tied.withColumn("__place", F.col("__place") + F.get(same, F.lit(0))["before"])
    tied = tied.withColumn("__cut", under(lambda c: F.col("__place") < c["size"])).drop("__place")
    return clear.unionByName(tied).drop("__u", "__cuts")
