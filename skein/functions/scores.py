"""Scores, costs and verdicts as column expressions. Null means unscorable, never wrong."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A reproducible number of 0 to 2**32 - 1: the first eight hex digits of the joined parts' MD5."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.left(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), F.lit(8)), 16, 10).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def argmax(values: Column) -> Column:
    """The place of the greatest value from 0, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def margin(values: Column) -> Column:
    """The best less the second; 0 for null or fewer than two values."""
    down = F.sort_array(values, asc=False)
    return F.when(F.size(F.coalesce(values, F.array().cast("array<double>"))) < 2, 0.0).otherwise(F.get(down, 0) - F.get(down, 1))


def softmax(values: Column) -> Column:
    """Shares of the exponentials, shifted by the greatest; empty for empty."""
    top = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda e: e / total)


def option_logs(logits: Column, forms: list[list[int]]) -> Column:
    """Log-softmax over a whole vocabulary, then each option's best surface form."""
    top = F.array_max(logits)
    norm = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.array(*[F.greatest(*[F.get(logits, i) - norm for i in dict.fromkeys(own)], F.lit(float("-inf"))) for own in forms])


def overlap_share(base: Column, other: Column) -> Column:
    """The share of the other's distinct words that base has too; 0 if it has none."""
    b = F.array_distinct(other)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(b, F.array_distinct(base))), F.size(b)), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def permuted(options: Column, row_id: Column, seed: int) -> Column:
    """The order of options under a seeded shuffle of each row: places from 0."""
    keyed = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.struct(draw("perm", F.lit(seed), row_id, i).alias("k"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda x: x["i"])


def drop_band(drop: Column) -> Column:
    return F.when(drop <= 0.03, "stable").when(drop <= 0.09, "mild").otherwise("strong")


def verbatim_band(rate: Column) -> Column:
    return F.when(rate < 0.05, "low").when(rate < 0.15, "moderate").otherwise("high")


def kappa_band(kappa: Column) -> Column:
    """Landis and Koch's names."""
    out = F.when(kappa < 0, "worse than chance")
    for cut, name in ((0.21, "slight"), (0.41, "fair"), (0.61, "moderate"), (0.81, "substantial")):
        out = out.when(kappa < cut, name)
    return out.otherwise("almost perfect")


def mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0))


def sample_sd(values: Column) -> Column:
    """The standard deviation with n - 1; 0 for fewer than two values."""
    m = mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(squares / F.greatest(F.size(values) - 1, F.lit(1))))


def first_mode(values: Column) -> Column:
    """The most frequent value, the first seen on ties; null for none."""
    kinds = F.array_distinct(values)
    counted = F.transform(kinds, lambda k, i: F.struct(F.size(F.filter(values, lambda v: v == k)).alias("n"), (-i).alias("i"), k.alias("k")))
    return F.array_max(counted)["k"]


def usd(seconds: Column, per_hour: float) -> Column:
    return seconds * F.lit(per_hour) / 3600


def usd_per_query(fixed: Column, marginal: Column, volume: Column) -> Column:
    """Fixed cost shared by the volume, and the marginal cost; a volume of 0 or less is an error."""
    bad = F.raise_error(F.lit("the volume must be positive")).cast("double")
    return F.when(volume > 0, fixed / volume + marginal).otherwise(bad)


def crossover(fixed_a: Column, marginal_a: Column, fixed_b: Column, marginal_b: Column) -> Column:
    """The volume at which two arms cost the same, rounded half to even; null if there is none."""
    at = F.try_divide(fixed_a - fixed_b, F.nullif(marginal_b - marginal_a, F.lit(0.0)))
    return F.when(at > 0, F.bround(at, 0).cast("bigint"))


def detectable_effect(n: Column, *, baseline: float = 0.5, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The least difference that n items can show."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n > 0, F.lit(z) * F.sqrt(F.lit(2 * baseline * (1 - baseline)) / n)).otherwise(
        F.raise_error(F.lit("n must be positive")).cast("double")
    )


def bucket(base: Column, tuned: Column, retrieved: Column) -> Column:
    """Where the arms disagree; null counts as wrong."""
    b, t, r = (F.coalesce(c, F.lit(False)) for c in (base, tuned, retrieved))
    return (
        F.when(t & ~r, "weights_only").when(r & ~t, "index_only").when(b & ~t & ~r, "both_broke_it")
        .when(~b & t & r, "both_fixed_it").when(b & t & r, "everyone_right").otherwise("everyone_wrong")
    )


def error_category(predicted: Column, gold: Column, gap: Column, other_right: Column) -> Column:
    """What kind of outcome an item is, compared with a reference arm if there is one."""
    right = predicted == gold
    return (
        F.when(predicted.isNull() | gold.isNull(), "unscorable")
        .when(right & (other_right == F.lit(False)), "fixed_by_retrieval")
        .when(~right & other_right, "broken_by_retrieval")
        .when(right, "correct").when(gap >= 1.0, "confident_wrong").when(gap <= 0.15, "near_miss").otherwise("wrong")
    )


def pairwise_outcome(forward: Column, backward: Column) -> Column:
    """Of two verdicts in both orders: unparseable, inconsistent, tie, A or B; the second is flipped already."""
    return (
        F.when(forward.isNull() | backward.isNull(), "unparseable").when(forward != backward, "inconsistent")
        .when(forward == "TIE", "tie").otherwise(forward)
    )


def chi2_tail(x: Column) -> Column:
    """P(X >= x) for chi-squared of one degree: erfc(sqrt(x / 2)).

    By the continued fraction of erfc for arguments above 2 and the series of erf below, both to
    rounding.
    """
    z = F.sqrt(x / 2)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("sum"), z.alias("term")),
        lambda s, k: F.struct(
            (s["sum"] + s["term"] * -z * z / k / (2 * k + 1)).alias("sum"), (s["term"] * -z * z / k).alias("term")
        ),
    )
    # sum of (-1)^k z^(2k+1) / (k! (2k+1)): each term carries 1/k!, the division by 2k+1 is its own
    series = 1 - F.lit(1.1283791670955126) * terms["sum"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, k: z + k / 2 / s)
    tail = F.exp(-z * z) / F.lit(1.772453850905516) / fraction
    return F.when(x <= 0, 1.0).when(z < 2, series).otherwise(tail)


def sign_tail(few: Column, n: Column) -> Column:
    """The two-sided exact binomial p of at most ``few`` of n at one half, for small n."""
    total = F.aggregate(
        F.sequence(F.lit(0), few.cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (n - i) / (i + 1)).alias("term")),
    )
    return F.least(F.lit(1.0), 2 * total["sum"] / F.pow(F.lit(2.0), n))
