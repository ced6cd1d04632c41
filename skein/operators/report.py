"""Costs, error taxonomies, pivots and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as sc
from ..functions import text as tx
from .retrieval import numbered


def cost_curve(arms: DataFrame, volumes: Sequence[int], *, per_hour: float) -> DataFrame:
    """arm, volume, usd_per_query, usd_per_1k for every arm (arm, fixed_s, query_s) and volume."""
    rows = arms.withColumn("volume", F.explode(F.array(*[F.lit(int(v)).cast("long") for v in volumes])))
    cost = sc.usd_per_query(sc.usd(F.col("fixed_s"), per_hour), sc.usd(F.col("query_s"), per_hour), F.col("volume"))
    return rows.select("arm", "volume", cost.alias("usd_per_query"), (cost * 1000).alias("usd_per_1k"))


def cheapest(curve: DataFrame, order: Sequence[str]) -> DataFrame:
    """The arm of least cost at each volume, the first in the order on ties."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("arm"))
    return curve.groupBy("volume").agg(F.min_by("arm", F.struct("usd_per_query", place)).alias("arm"))


def fixed_costs(arms: DataFrame, indices: DataFrame, training: DataFrame) -> DataFrame:
    """arm, fixed_s, query_s: the seconds of an arm's training and index, and of one query.

    Args:
        arms: arm, uses_adapter, corpus, p50_s.
        indices: corpus, embed_gpu_seconds; training: train_gpu_seconds, a row at most. An arm
            with an adapter takes it, one with a corpus its index's; what is missing counts as 0.
    """
    built = indices.groupBy("corpus").agg(F.max("embed_gpu_seconds").alias("built"))
    trained = training.agg(F.coalesce(F.max("train_gpu_seconds"), F.lit(0.0)).alias("trained"))
    rows = arms.join(F.broadcast(built), "corpus", "left").crossJoin(F.broadcast(trained))  # one row a corpus, one row
    adapter = F.when(F.col("uses_adapter"), F.col("trained")).otherwise(0.0)
    return rows.select("arm", (adapter + F.coalesce("built", F.lit(0.0))).alias("fixed_s"), F.coalesce("p50_s", F.lit(0.0)).alias("query_s"))


def known_arms(rows: DataFrame, names: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The rows of the named arms; a name that isn't known is an error that lists those that are."""
    if unknown := [n for n in names if n not in known]:
        raise KeyError(f"unknown arms {', '.join(unknown)}; known are {', '.join(known)}")
    return rows.filter(F.col("arm").isin(*names))


def experiment_order(arm: Column, order: Sequence[str]) -> Column:
    """An arm's place in the experiment, unknown arms after all others."""
    at = F.array_position(F.array(*map(F.lit, order)), arm)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def told_p(p: Column) -> Column:
    """A p value for a table: one digit and an exponent below 0.0001, else four or three places."""
    small = F.regexp_replace(F.format_string("%.0e", p), "e-0", "e-")
    return F.when(p < 0.0001, small).when(p < 0.001, tx.fixed(p, 4)).otherwise(tx.fixed(p, 3))


def _interval(low: str, high: str, digits: int, *, percent: bool = False, plus: bool = False) -> Column:
    """Both ends in brackets."""
    ends = [tx.fixed((100 if percent else 1) * F.col(c), digits, plus=plus) for c in (low, high)]
    return F.concat(F.lit("["), ends[0], F.lit(", "), ends[1], F.lit("]"))


def freetext_rows(arms: DataFrame, intervals: DataFrame, accuracy: DataFrame, *, bound: int | None = None) -> DataFrame:
    """Formatted rows of judged arms, best first by place.

    Args:
        arms: arm, graded, judge_sd, capped (null where answers' lengths aren't known), n.
        intervals: arm, low, high, of the mean grade. accuracy: arm, accuracy; a dash stands where
            it isn't known.
        bound: the greatest number of tokens of an answer, told beside the share of capped ones.

    Returns:
        place, arm, score (the best in bold), interval, judge_sd, capped, accuracy.
    """
    rows = arms.join(F.broadcast(intervals), "arm").join(F.broadcast(accuracy), "arm", "left")  # a row an arm
    rows = rows.withColumn("place", F.row_number().over(W.orderBy(F.col("graded").desc(), "arm")))
    bold = F.when(F.col("place") == 1, "**").otherwise("")
    at = F.lit("" if bound is None else f" @{bound}")
    return rows.select(
        "place", "arm", F.concat(bold, tx.fixed(F.col("graded"), 3), bold).alias("score"), _interval("low", "high", 2).alias("interval"),
        tx.fixed(F.col("judge_sd"), 3).alias("judge_sd"),
        F.when(F.col("capped").isNull(), "—").otherwise(F.concat(tx.fixed(100 * sc.share(F.col("capped"), F.col("n")), 0), F.lit("%"), at)).alias("capped"),
        F.when(F.col("accuracy").isNull(), "—").otherwise(tx.percent(F.col("accuracy"))).alias("accuracy"),
    )


def delta_rows(deltas: DataFrame, pairwise: DataFrame, accuracy: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Formatted rows of paired differences in points, in bold where p is below alpha, the greatest first by place.

    Args:
        deltas: arm_a, arm_b, n, delta, low, high, p.
        pairwise: arm_a, arm_b, a_wins, b_wins, position_bias_rate; accuracy: arm, accuracy. Where
            either is missing a dash stands.
    """
    told = lambda side: F.broadcast(accuracy.select(F.col("arm").alias(f"arm_{side}"), F.col("accuracy").alias(f"acc_{side}")))
    rows = deltas.join(F.broadcast(pairwise), ["arm_a", "arm_b"], "left").join(told("a"), "arm_a", "left").join(told("b"), "arm_b", "left")
    both = F.concat(F.format_string("%d-%d (", "a_wins", "b_wins"), tx.fixed(100 * F.col("position_bias_rate"), 0), F.lit("% flipped)"))
    bold = F.when(F.col("p") < alpha, "**").otherwise("")
    return rows.select(
        F.row_number().over(W.orderBy(F.col("delta").desc(), "arm_a", "arm_b")).alias("place"), "arm_a", "arm_b", "n",
        F.concat(bold, tx.fixed(100 * F.col("delta"), 1, plus=True), bold).alias("delta"),
        _interval("low", "high", 1, percent=True, plus=True).alias("interval"), told_p(F.col("p")).alias("p"),
        F.coalesce(F.when(F.col("acc_a").isNotNull() & F.col("acc_b").isNotNull(), tx.fixed(100 * (F.col("acc_a") - F.col("acc_b")), 1, plus=True)), F.lit("—")).alias("accuracy_delta"),
        F.coalesce(F.when(F.col("a_wins").isNotNull(), both), F.lit("—")).alias("pairwise"),
    )


def answer_rows(items: DataFrame, answers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rendered answers of the arms to each item, in the experiment's order by place.

    Args:
        items: question_id, options (an array), answer_idx.
        answers: arm, question_id, predicted_idx, confidence, prompt_tokens, any of which may be null.

    Returns:
        question_id, place, arm, answered (label and option, a dash without an answer), correct, verdict,
        confidence, prompt_tokens.
    """
    rows = answers.join(items, "question_id")
    labels = F.array(*map(F.lit, tx.LABELS))
    said = F.concat(F.get(labels, "predicted_idx"), F.lit(". "), F.get("options", F.col("predicted_idx")))
    right = F.coalesce(F.col("predicted_idx") == F.col("answer_idx"), F.lit(False))
    return rows.select(
        "question_id", experiment_order(F.col("arm"), order).cast("int").alias("place"), "arm", F.coalesce(said, F.lit("—")).alias("answered"),
        right.alias("correct"), F.when(right, "correct").otherwise("wrong").alias("verdict"),
        F.when(F.col("confidence").isNull(), "—").otherwise(F.concat(tx.fixed(100 * F.col("confidence"), 0), F.lit("%"))).alias("confidence"),
        F.coalesce(F.col("prompt_tokens").cast("string"), F.lit("—")).alias("prompt_tokens"),
    )


def item_choices(items: DataFrame, *, longest: int = 90) -> DataFrame:
    """question_id, label: subject and stem (question, subject) with its white space folded, cut with an ellipsis if it's long."""
    stem = tx.fold_space(F.col("question"))
    short = F.when(F.length(stem) <= longest, stem).otherwise(F.concat(F.left(stem, F.lit(longest - 3)), F.lit("…")))
    return items.select("question_id", F.concat(F.lit("["), "subject", F.lit("] "), short).alias("label"))


def same_items(preds: DataFrame, *, by: tuple[str, ...] = ("arm", "seed"), key: str = "question_id") -> DataFrame:
    """The predictions, unless runs were made on different items: then an error that names some of the runs.

    Runs are told apart by number and sums of two hashes of their items' keys, which tasks add up
    without order.
    """
    parts = [F.sum(F.xxhash64(F.col(key).cast("string"), F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    runs = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *parts)
    kinds = runs.groupBy("n", "h1", "h2").agg(F.count(F.lit(1)).alias("runs"), F.min(F.concat_ws(" ", *[F.col(c).cast("string") for c in by])).alias("one"))
    if len(found := kinds.orderBy(F.col("runs").desc()).limit(5).collect()) > 1:
        raise ValueError("runs on different items: " + ", ".join(f"{r['one']} has {r['n']} items" for r in found))
    return preds


#: The mark of an arm that was measured on a device that others used too.
CONTENDED = " ⚠"


def results_rows(arms: DataFrame, *, headline_only: bool = False) -> DataFrame:
    """Formatted rows of the main table; every cell but the spread is of the reference run.

    Args:
        arms: arm, headline, exclusive, accuracy, low, high, n_seeds, mean, sd, p50, p95 (seconds),
            prompt_tokens, hit_rate, grounded_rate (null for arms without retrieval).
    """
    rows = arms.filter("headline") if headline_only else arms
    pct = lambda c: 100 * F.col(c)
    dash = lambda c: F.when(F.col(c).isNull(), "—").otherwise(tx.fixed(F.col(c), 3))
    spread = F.when(F.col("n_seeds") > 1, F.concat(tx.fixed(pct("mean"), 1), F.lit(" ± "), tx.fixed(pct("sd"), 1), F.format_string(" (n=%d)", "n_seeds"))).otherwise("—")
    return rows.select(
        F.concat("arm", F.when(F.col("exclusive"), "").otherwise(CONTENDED)).alias("arm"), tx.percent(F.col("accuracy")).alias("accuracy"),
        _interval("low", "high", 1, percent=True).alias("interval"), spread.alias("seeds"),
        *[F.concat(tx.fixed(1000 * F.col(c), 0), F.lit(" ms")).alias(c) for c in ("p50", "p95")], tx.fixed(F.col("prompt_tokens"), 0).alias("prompt_tokens"),
        dash("hit_rate").alias("retrieval_hit"), dash("grounded_rate").alias("grounded"),
    )


def crossovers(arms: DataFrame, *, per_hour: float, low: int, high: int) -> DataFrame:
    """arm_a, arm_b, volume: where pairs of arms cost the same, within the volumes of the sweep."""
    a = arms.select(*[F.col(c).alias(f"{c}_a") for c in arms.columns])
    b = arms.select(*[F.col(c).alias(f"{c}_b") for c in arms.columns])
    pairs = a.join(F.broadcast(b), F.col("arm_a") < F.col("arm_b"))  # a few arms
    parts = [sc.usd(F.col(c), per_hour) for c in ("fixed_s_a", "query_s_a", "fixed_s_b", "query_s_b")]
    return pairs.select("arm_a", "arm_b", sc.crossover(*parts).alias("volume")).filter(F.col("volume").between(low, high))


def pivot(rows: DataFrame, index: str, arms: Sequence[str], value: str) -> DataFrame:
    """A row per index and a column per arm; the arms are given, so that none need be sought."""
    return rows.groupBy(index).pivot("arm", list(arms)).agg(F.first(value))


def per_subject(preds: DataFrame) -> DataFrame:
    """arm, subject, n and accuracy over scorable items (ok not null)."""
    rows = preds.filter("ok is not null")
    return rows.groupBy("arm", "subject").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def collect_errors(preds: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Outcomes (arm, question_id, subject, category, margin) but correct and unscorable ones.

    With a reference run (question_id, ok) items are told apart that it got right or wrong.
    What retrieval fixed is listed too, though it's right.
    """
    if reference is None:
        rows = preds.withColumn("other", F.lit(None).cast("boolean"))
    else:
        told = reference.select(F.col("question_id").alias("__q"), F.col("ok").alias("other"))
        rows = preds.join(told, F.col("question_id") == F.col("__q"), "left").drop("__q")
    gap = sc.margin(F.col("option_logs"))
    kind = sc.error_category(F.col("predicted_idx"), F.col("answer_idx"), gap, F.col("other"))
    rows = rows.select("arm", "question_id", "subject", kind.alias("category"), gap.alias("margin"))
    return rows.filter(~F.col("category").isin("correct", "unscorable"))


def review_sheet(cases: DataFrame) -> DataFrame:
    """Cases with empty columns for a human's label and notes."""
    return cases.withColumns({"human_label": F.lit(""), "notes": F.lit("")})


def comparison_rows(tests: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Formatted rows of paired tests."""
    return tests.select(
        F.concat("arm_a", F.lit(" vs "), "arm_b").alias("comparison"),
        tx.fixed(F.col("delta"), 3, plus=True).alias("delta_accuracy"),
        F.concat_ws("/", F.col("a_only").cast("string"), F.col("b_only").cast("string")).alias("discordant"),
        F.when(F.col("p") < 1e-4, "<0.0001").otherwise(tx.fixed(F.col("p"), 4)).alias("p"),
        F.when(F.col("p") < alpha, "significant").otherwise("not significant").alias("verdict"),
    )


def provenance(runs: DataFrame) -> DataFrame:
    """n and the split's digest, or MIXED if the runs differ."""
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.when(F.count_distinct("split_sha256") == 1, F.min("split_sha256")).otherwise("MIXED").alias("split"),
    )


def payload(arms: DataFrame, costs: DataFrame, items: DataFrame, *, seed: int, git: str | None = None, device: str | None = None) -> DataFrame:
    """A demonstration's payload: one row of arms, costs, items (arrays, in order) and provenance.

    The provenance tells the split by the SHA-256 of the items' sorted ids, their number, the seed, and
    what is given of git and device; what isn't is null.

    Args:
        arms: arm and more, a row an arm; costs: likewise. items: question_id and more, a small frozen set.
    """
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    ids = F.array_sort(F.transform("items", lambda i: i["question_id"].cast("string")))
    told = F.struct(
        F.sha2(F.array_join(ids, "\n"), 256).alias("split_sha256"), F.size("items").cast("long").alias("n_items"), F.lit(seed).alias("seed"),
        F.lit(git).cast("string").alias("git"), F.lit(device).cast("string").alias("device"),
    )
    rows = listed(arms, "arms").crossJoin(listed(costs, "costs")).crossJoin(listed(items, "items"))  # one row each
    return rows.withColumn("provenance", told)


def hours_by_group(jobs: DataFrame) -> DataFrame:
    """Hours and statuses of jobs (name, grp, hours, status) by group."""
    return jobs.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.sum("hours").alias("hours"),
        F.count_if(F.col("status") == "done").alias("done"),
    )


def job_problems(jobs: DataFrame, deps: DataFrame) -> DataFrame:
    """Names that occur twice, and dependencies (name, dep) unknown, later (pos) or of another group."""
    twice = jobs.groupBy("name").count().filter("count > 1").select("name", F.lit(None).cast("string").alias("dep"), F.lit("repeated").alias("problem"))
    other = jobs.select(F.col("name").alias("dep"), F.col("pos").alias("dep_pos"), F.col("grp").alias("dep_grp"))
    met = deps.join(jobs, "name").join(other, "dep", "left")
    problem = F.when(F.col("dep_pos").isNull(), "unknown").when(F.col("dep_pos") >= F.col("pos"), "later").when(F.col("dep_grp") != F.col("grp"), "group")
    return twice.unionByName(met.select("name", "dep", problem.alias("problem")).filter("problem is not null"))


def queue_order(jobs: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Jobs with their place in the queue: by their group's rank, then as they came."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("grp")), F.lit(len(ranks)))
    placed = numbered(jobs.withColumn("__rank", rank), "__rank", "pos")
    return placed.withColumn("place", F.col("index") + 1).drop("__rank", "index")


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path (run, path) of the greatest step number of each run."""
    step = F.regexp_extract("path", r"checkpoint-([0-9]+)", 1)
    return paths.filter(step != "").groupBy("run").agg(F.max_by("path", step.cast("long")).alias("path"))


def answer_accounting(answers: DataFrame, *, bound: int | None, by: str = "arm") -> DataFrame:
    """Empty and capped answers (answer, completion_tokens) and their mean length by arm."""
    capped = F.count_if(F.col("completion_tokens") >= bound) if bound is not None else F.lit(0).cast("long")
    return answers.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tx.strip(F.coalesce("answer", F.lit(""))) == "").alias("empty_answers"),
        capped.alias("capped_answers"), F.coalesce(F.avg("completion_tokens"), F.lit(0.0)).alias("mean_completion_tokens"),
    )
