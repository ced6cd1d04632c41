"""Judges' grades: items over seeds, arms, pairs and strict scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx


def item_grades(replies: DataFrame) -> DataFrame:
    """arm, question_id, scores (in the order of seeds), unparseable, mean, sd, majority.

    Replies without a grade are counted apart and aren't 0. The majority of no grade is null.
    """
    rows = replies.withColumn("score", tx.parse_score(F.col("reply")))
    per = rows.groupBy("arm", "question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("seed", "score")))).alias("told"),
        F.count_if(F.col("score").isNull()).alias("unparseable"),
    )
    scores = F.transform("told", lambda t: t["score"].cast("double"))
    per = per.select("arm", "question_id", scores.alias("scores"), "unparseable")
    return per.withColumns({"mean": sc.mean(F.col("scores")), "sd": sc.sample_sd(F.col("scores")), "majority": sc.first_mode(F.col("scores")).cast("int")})


def arm_grades(items: DataFrame) -> DataFrame:
    """Of each arm n, the mean normalised grade, the mean spread over seeds and the failures.

    An item without a grade counts 0 here; ``strict_grades`` drops it.
    """
    return items.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("mean") / 2).alias("mean_score"), F.avg("sd").alias("judge_sd"), F.sum("unparseable").alias("unparseable")
    )


def strict_grades(items: DataFrame) -> DataFrame:
    """arm, question_id, graded (mean / 2) and strict (1 if the majority is 2), for items with a grade."""
    rows = items.filter(F.size("scores") > 0)
    return rows.select("arm", "question_id", (F.col("mean") / 2).alias("graded"), (F.col("majority") == 2).cast("int").alias("strict"))


def pairwise_summary(pairs: DataFrame, by: str = "pair") -> DataFrame:
    """Wins, ties and failures of two orders of judging (forward, reversed replies).

    Precedence: unparseable, inconsistent, tie, then the winner. The bias rate is the share of
    inconsistent items.
    """
    rows = pairs.withColumn("outcome", sc.pairwise_outcome(tx.parse_verdict(F.col("forward")), tx.flip(tx.parse_verdict(F.col("reversed")))))
    of = lambda o: F.count_if(F.col("outcome") == o)
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(
        n.alias("n"), of("A").alias("a_wins"), of("B").alias("b_wins"), of("tie").alias("ties"), of("inconsistent").alias("inconsistent"),
        of("unparseable").alias("unparseable"), (of("inconsistent") / n).alias("position_bias_rate"),
    )
