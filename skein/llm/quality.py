"""Quality rules whose cutoffs carry an exact bound on wrongly rejected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import hinted, let, store, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30

#: Rules by name: each is a share of 0 to 1 of which large values speak against a text.
RULES = {
    "symbols": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "bangs": lambda c: c("n_bangs") / F.greatest(c("word_chars"), F.lit(1)),
    "upper": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "repeats": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "dup_lines": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
}

#: What a good document wrongly rejected weighs against a bad one rejected, by their shares. The
#: value was set by a look at labels of the fixtures; it decides where cutoffs aim, and the bound
#: on wrongly rejected documents holds whatever it is.
PRICE = 25.0

#: Steps of the grid of cutoffs between 0 and 1.
STEPS = 100


def _repeated(hashes: Column, n: Column) -> Column:
    """Words within windows whose hash occurs twice or more; n: the number of windows."""

    def covered(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        twice = F.filter(pairs, lambda p, k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return let(
            F.sort_array(F.transform(twice, lambda p: p["at"])),
            lambda at: F.aggregate(
                F.transform(at, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - a, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )

    paired = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(let(paired, covered))


def text_measures(text: Column) -> dict[str, Column]:
    """Counts over the whole text; null counts as empty. All are of type long.

    n_repeat_words takes windows for equal if 64-bit hashes of their words agree; among the
    windows of one text a chance agreement is beyond reach.
    """
    text = F.coalesce(text, F.lit(""))

    def joined(hs: Column, step: int) -> Column:
        """Hashes of two stretches of words, the second step words after the first."""
        return let(hs, lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))

    def repeats(ws: Column) -> Column:
        n = F.size(ws) - (WINDOW - 1)
        hashed = F.transform(ws, lambda w: F.xxhash64(w))
        for step in (1, 2, 4):
            hashed = joined(hashed, step)
        windows = let(F.slice(hashed, F.lit(1), n), lambda h: _repeated(h, n))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.when(n > 1, windows).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\t-\\r ]")))
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {
        "of_words": let(words(text), repeats),
        "word_chars": count("[\\t-\\r ]+").cast("long"),
        "n_symbols": count(f"[^{SYMBOLS}]+").cast("long"),
        "n_bangs": count("[^!]+").cast("long"),
        "n_upper": count("[^\\p{Lu}]+").cast("long"),
        "of_lines": let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            ),
        ),
    }


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of ``text_measures`` and base_failed, their names prefixed."""
    made = text_measures(F.col(text_col))
    p = prefix
    out = docs.withColumns({f"{p}{k}": v for k, v in made.items()})
    out = out.withColumns({f"{p}{c}": F.col(f"{p}{s}.{c}") for s, c in (("of_words", "n_words"), ("of_words", "n_repeat_words"), ("of_lines", "n_lines"), ("of_lines", "n_dup_lines"))})
    n, r = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    return out.withColumn(f"{p}base_failed", (n < LEAST_WORDS) | (100 * r > REPEAT_PERCENT * n)).drop(f"{p}of_words", f"{p}of_lines")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, carried back by the recurrence; for x >= 1."""
    y = x + 8
    back = F.lit(1.0)
    for i in range(8):
        back = back * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.log(back)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p) and k < n p, exact to rounding.

    The terms are summed downward from k, each from the one above by their ratio; those
    beyond 40 standard deviations add nothing to a double.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    reach = F.least(k, F.ceil(40 * F.sqrt(n * F.lit(p * (1 - p))) + 40)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), reach),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct(
            (a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - j) / (n - k + j + 1) * F.lit((1 - p) / p)).alias("term")
        ),
    )
    return F.exp(top) * total["sum"]


def _counts_above(cells: DataFrame, *keys: str) -> DataFrame:
    """For each cut of 0 to STEPS the labelled documents in cells above it, and all of them.

    cells: the keys, quality and cell, a row per document.
    """
    held = cells.groupBy(*keys, "cell").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    held = held.select(*keys, "good", "bad", "cell", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("cut"))
    over = lambda c: F.sum(F.when(F.col("cell") > F.col("cut"), F.col(c)).otherwise(0)).alias(f"above_{c}")
    return held.groupBy(*keys, "cut").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), over("good"), over("bad"))


def _gain() -> Column:
    share = lambda c: F.col(f"above_{c}") / F.greatest(F.col(f"n_{c}"), F.lit(1))
    return share("bad") - PRICE * share("good")


def tuning_half(doc_id: Column) -> Column:
    """Whether a labelled document serves to aim the cutoffs; the others certify them."""
    digit = F.left(F.md5(F.concat(F.lit("29|"), doc_id.cast("string"))), F.lit(1))
    return F.conv(digit, 16, 10).cast("int") % 2 == 0


def certified_cutoffs(
    measures: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = 0.02, doubt: float = 0.05
) -> DataFrame:
    """Cutoffs that together reject few good documents, by exact binomial bounds on labelled ones.

    One half of the labelled documents, by hash of the id, aims: in every stratum each rule's
    cutoff is that at which the share of bad documents above it exceeds PRICE times that of good
    ones most, on a tie the loosest. From no rejection at all to these aims all rules of a
    stratum are tightened together in STEPS steps. The other half, which had no part in the
    aims, tests the steps from the loosest on: a step passes if so few good documents are
    rejected by any rule that, were the true share ``risk`` or more, the exact binomial chance
    of so few would be at most ``doubt`` / number of strata. A stratum's tests end at the first
    failure, so that one such level covers all its steps; the division corrects for the number
    of strata. With probability 1 - doubt, therefore, in no stratum the rules together reject a
    share of ``risk`` or more of the good documents that pass the base rules. Of the certified
    steps that of the best gain is taken, on a tie the loosest.

    Args:
        measures: doc_id, the stratum and the counts of every document.
        labels: doc_id and quality, 1 or 0; rows with nulls are ignored.

    Returns:
        stratum, rule, cutoff, n_good, above_good: a row per rule and stratum with a certified
        step; the counts are the stratum's, of all rules together. Documents of a value above
        the cutoff are rejected.
    """
    labels = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = [F.struct(F.lit(name).alias("rule"), F.least(F.ceil(rule(F.col) * STEPS), F.lit(STEPS)).cast("int").alias("cell")) for name, rule in RULES.items()]
    rows = measures.filter("not base_failed").select("doc_id", F.col(stratum).alias("stratum"), F.array(*values).alias("cells")).join(labels, "doc_id")
    rows = store(rows.select("stratum", "quality", "cells", tuning_half(F.col("doc_id")).alias("tuning")), "labelled")
    aims = _counts_above(rows.filter("tuning").select("stratum", "quality", F.inline("cells")), "stratum", "rule")
    aims = aims.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct(_gain(), "cut")).alias("aim"))
    aims = store(aims.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "aim"))).alias("aims")), "aims")
    tests = rows.filter("not tuning").join(hinted(aims), F.col("stratum").eqNullSafe(F.col("of")))

    def tightest(x: Column) -> Column:
        """The step, counted from the aims, below which the rule rejects the document."""
        aim = F.col("aims")[x["rule"]]
        return F.when(x["cell"] > aim, F.ceil(STEPS * (x["cell"] - aim) / (STEPS - aim))).otherwise(0).cast("int")

    above = _counts_above(tests.select("stratum", "quality", F.array_max(F.transform("cells", tightest)).alias("cell")), "stratum")
    strata = F.count(F.when(F.col("cut") == STEPS, 1)).over(W.partitionBy(F.lit(0)))
    above = above.withColumn("level", F.lit(doubt) / strata)
    few = F.col("above_good") < F.col("n_good") * risk
    passed = F.when(few, binomial_tail(F.col("above_good"), F.col("n_good"), risk) <= F.col("level")).otherwise(False)
    down = W.partitionBy("stratum").orderBy(F.col("cut").desc()).rowsBetween(W.unboundedPreceding, 0)
    above = above.withColumn("passed", F.min(passed).over(down)).filter("passed")
    best = above.groupBy("stratum").agg(F.max_by(F.struct("cut", "n_good", "above_good"), F.struct(_gain(), "cut")).alias("b"))
    best = best.join(aims, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "b", F.explode("aims").alias("rule", "aim"))
    cut = F.col("aim") + F.floor(F.col("b.cut") * (STEPS - F.col("aim")) / STEPS)
    return best.select("stratum", "rule", (cut / STEPS).alias("cutoff"), "b.n_good", "b.above_good")


def _by_stratum(cutoffs: DataFrame) -> DataFrame:
    """One row per stratum with its cutoffs as a map."""
    return cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def _rejected(cutoffs: Column, prefix: str = "") -> Column:
    column = lambda name: F.col(f"{prefix}{name}")
    cell = lambda rule: F.ceil(rule(column) * STEPS) / STEPS
    tests = [F.coalesce(cell(rule) > cutoffs[name], F.lit(False)) for name, rule in RULES.items()]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """Judge every document by the base rules and by certified cutoffs.

    Documents of a stratum without certified cutoffs, null included, are judged by the base
    rules alone: without enough labels no bound holds. Empty and null texts have no words and
    fail the base rules. Texts of any length are measured whole. An empty table gives an empty
    one; repeated rows are judged alike; columns besides doc_id, text and the stratum don't
    matter, whatever their names.

    Returns:
        doc_id, the counts, base_failed and kept: a row per input row.
    """
    rows = store(measured(docs.select("doc_id", F.col(stratum).alias("stratum"), "text")).drop("text"), "measures")
    cutoffs = store(_by_stratum(certified_cutoffs(rows, labels, stratum="stratum", risk=risk, doubt=doubt)), "cutoffs")
    cutoffs = hinted(cutoffs.withColumnRenamed("stratum", "of"))
    rows = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return rows.withColumn("kept", ~F.col("base_failed") & ~_rejected(F.col("cutoffs"))).drop("of", "stratum", "cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The labelled documents are measured to find the cutoffs; then every document is measured
    and judged where it lies, so that no text is shuffled to be filtered.
    """
    p = "__skein_"
    known = labels.select("doc_id").where("doc_id is not null and quality is not null").distinct()
    sample = docs.select("doc_id", F.col(stratum).alias("stratum"), "text").join(hinted(known), "doc_id", "left_semi")
    known = store(measured(sample).drop("text"), "measures")
    found = certified_cutoffs(known, labels, stratum="stratum", risk=risk, doubt=doubt)
    cutoffs = hinted(store(_by_stratum(found), "cutoffs").withColumnsRenamed({"stratum": f"{p}of", "cutoffs": f"{p}cutoffs"}))
    # A column that differs by row keeps the filters above the measures, which are costly, so
    # that they are made once; filters pushed below would make them again.
    rows = measured(docs, prefix=p).withColumn(f"{p}row", F.monotonically_increasing_id())
    rows = rows.filter(~F.col(f"{p}base_failed") & (F.col(f"{p}row") >= 0))
    rows = rows.join(cutoffs, F.col(stratum).eqNullSafe(F.col(f"{p}of")), "left")
    return rows.filter(~_rejected(F.col(f"{p}cutoffs"), p)).select(*[docs[c] for c in docs.columns])
