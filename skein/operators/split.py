"""Splits and samples that depend on seeds and keys alone, never on the order of rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..sources.scratch import store
from .retrieval import numbered
from .selection import smallest


def seeded(seed: int, *keys: Column | str) -> Column:
    """A key to shuffle by: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def quotas(rows: DataFrame, stratum: str, wanted: dict[str, int]) -> DataFrame:
    """Largest-remainder shares of the wanted sizes: stratum, n and a column per size.

    Shares are rounded down; those of the greatest remainders get one more, by name on ties,
    until the sizes are met. The arithmetic is of whole numbers.
    """
    per = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    for name, want in wanted.items():
        product = F.col("n") * F.lit(want)
        per = per.withColumns({"__low": F.expr(f"n * {want} div total"), "__rest": product % F.col("total")})
        short = F.lit(want) - F.sum("__low").over(W.partitionBy(F.lit(0)))
        place = F.row_number().over(W.orderBy(F.col("__rest").desc(), stratum))
        per = per.withColumn(name, F.col("__low") + F.when(place <= short, 1).otherwise(0)).drop("__low", "__rest")
    return per.drop("total")


def stratified_split(rows: DataFrame, *, stratum: str, test: int, val: int, seed: int = 42, key: str = "id") -> DataFrame:
    """key, stratum, split: test, val or reserve, in proportion to the strata.

    A stratum's rows are in the order of seeded MD5s. The last key of each split is sought by
    histograms, so that a stratum of all rows is in no task; rows then tell their split by themselves.
    """
    shares = quotas(rows, stratum, {"n_test": test, "n_val": val})
    wanted = shares.select(stratum, F.array("n_test", F.col("n_test") + F.col("n_val")).alias("cuts"))
    drawn = seeded(seed, key)
    made = smallest(rows.select(key, stratum), wanted, by=stratum, key=F.conv(F.left(drawn, F.lit(15)), 16, 10).cast("long"), ties=[drawn, key])
    name = F.when(F.col("__cut") == 0, "test").when(F.col("__cut") == 1, "val").otherwise("reserve")
    return made.select(key, stratum, name.alias("split"))


def id_digest(ids: DataFrame, by: str, key: str = "id") -> DataFrame:
    """by, n, digest: the SHA-256 of a split's ids, sorted as text and joined by line feeds.

    A digest reads its ids one after another. They are sorted in ranges, which then stream
    through the driver a range at a time, so that nothing holds all ids.
    """
    rows = ids.select(by, F.col(key).cast("string").alias("__id")).filter("__id is not null")
    ranged = store(rows.repartitionByRange(by, "__id").sortWithinPartitions(by, "__id").withColumn("__at", F.monotonically_increasing_id()), "ids")
    told: dict = {}
    for name, one, _ in ranged.orderBy("__at").toLocalIterator():
        count, digest = told.get(name, (0, hashlib.sha256()))
        digest.update(("\n" if count else "").encode() + one.encode())
        told[name] = (count + 1, digest)
    schema = T.StructType([ids.schema[by], T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    return ids.sparkSession.createDataFrame([(name, n, digest.hexdigest()) for name, (n, digest) in told.items()], schema)


def tree_digest(ids: DataFrame, by: str, key: str = "id") -> DataFrame:
    """by, n, digest: a digest of each group's ids that tasks make together, whatever the number of ids.

    Ids fall into 65,536 leaves by their MD5. A leaf's digest is the SHA-256 of its sorted ids; those of
    256 leaves make that of a knot, those of the knots the group's. So it depends on the ids alone, and no
    task holds more than a leaf. Null ids are left out.
    """
    rows = ids.select(by, F.col(key).cast("string").alias("__id")).filter("__id is not null")
    joined = lambda parts: F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256).alias("d")
    leaves = rows.groupBy(by, F.left(F.md5("__id"), F.lit(4)).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), joined(F.col("__id")))
    knots = leaves.groupBy(by, F.left("leaf", F.lit(2)).alias("knot")).agg(F.sum("n").alias("n"), joined(F.concat("leaf", "d")))
    return knots.groupBy(by).agg(F.sum("n").alias("n"), joined(F.concat("knot", "d"))).withColumnRenamed("d", "digest")


def shared_ids(ids: DataFrame, by: str = "split", key: str = "id") -> DataFrame:
    """Ids in more than one split, with the splits: none if the splits are disjoint."""
    found = ids.groupBy(key).agg(F.array_sort(F.collect_set(by)).alias("splits"))
    return found.filter(F.size("splits") > 1)


def verify_manifest(ids: DataFrame, recorded: DataFrame, by: str = "split") -> DataFrame:
    """Splits whose number or digest differs from the recorded ones, with the problem."""
    actual = id_digest(ids, by)
    both = recorded.withColumnsRenamed({"n": "want_n", "digest": "want"}).join(actual, by, "full")
    problem = (
        F.when(F.col("want").isNull(), "unrecorded").when(F.col("digest").isNull(), "missing")
        .when(F.col("n") != F.col("want_n"), "count").when(F.col("digest") != F.col("want"), "digest")
    )
    return both.select(by, problem.alias("problem")).filter("problem is not null")


def grouped_holdout(rows: DataFrame, *, n_train: int, n_test: int, seed: int = 42) -> DataFrame:
    """Split question-answer pairs by passage, holding one question of each passage out.

    Repeated pairs (folded, lower case) are dropped, the first stays. Passages with one question
    are left out. Passages are taken in seeded order while the training questions of those before
    are fewer than ``n_train``; one question of each is held out, the others train. Held-out
    questions whose text is also in training are dropped, and ``n_test`` of the rest are tested.

    Args:
        rows: id, pos, passage, question, answer.

    Returns:
        id, passage, split: train or test.
    """
    rows = rows.withColumns({"q": tx.norm(F.col("question")), "a": tx.norm(F.col("answer"))})
    first = F.row_number().over(W.partitionBy("q", "a").orderBy("pos", "id"))
    rows = rows.withColumn("first", first).filter("first = 1").drop("first")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("passage"))).filter("size >= 2")
    groups = rows.groupBy("passage").agg((F.count(F.lit(1)) - 1).alias("trains"))
    groups = numbered(groups.withColumn("key", seeded(seed, "passage")), "key", "passage", weight="trains")
    taken = rows.join(groups.filter(F.col("before") < n_train).select("passage"), "passage", "left_semi")
    place = F.row_number().over(W.partitionBy("passage").orderBy(seeded(seed, "id"), "id"))
    taken = taken.withColumn("held", place == 1)
    train = taken.filter("not held")
    held = taken.filter("held").join(train.select("q").distinct(), "q", "left_anti")
    test = sample_rows(held, n_test, seed=seed + 1)
    return train.select("id", "passage", F.lit("train").alias("split")).unionByName(
        test.select("id", "passage", F.lit("test").alias("split"))
    )


def refuse_held_out(rows: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """The rows, unless one of their keys is held out: then an error that names some of them."""
    hits = [r[0] for r in rows.join(held.select(key).distinct(), key, "left_semi").select(key).limit(5).collect()]
    if hits:
        raise ValueError(f"held-out items among the sources: {', '.join(map(str, hits))}")
    return rows


def freetext_items(questions: DataFrame, n: int, *, seed: int = 42, key: str = "id") -> DataFrame:
    """n items that can be asked without their options, in seeded order; too few are an error.

    Args:
        questions: key, gold (the text of the gold option; null without a label).
    """
    fit = questions.filter(F.col("gold").isNotNull() & tx.option_dependent(F.col("gold")).isNull())
    out = sample_rows(fit, n, seed=seed, key=key)
    if (found := out.count()) < n:
        raise ValueError(f"{n} items are asked for; {found} have a label and can be graded without options")
    return out


def sample_per(rows: DataFrame, bucket: str, n: int, *, seed: int = 42, key: str = "id") -> DataFrame:
    """At most n rows of each bucket, in seeded order."""
    place = F.row_number().over(W.partitionBy(bucket).orderBy(seeded(seed, key), key))
    return rows.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def sample_rows(rows: DataFrame, n: int, *, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows in seeded order: a sort with a limit, so that tasks hand on n rows each."""
    return rows.withColumn("__k", seeded(seed, key)).orderBy("__k", key).limit(n).drop("__k")


def sheet_sample(graded: DataFrame, n: int, *, key: str = "id", grade: str = "grade") -> DataFrame:
    """n items for human grading: an equal share of each grade by id, then others by grade and id."""
    grades = graded.select(grade).distinct().count()
    share = max(1, n // max(grades, 1))
    place = F.row_number().over(W.partitionBy(grade).orderBy(key))
    # Items within their grade's share are all taken; the others fill up what is left. A limit
    # keeps as many per task and grade.
    taken = graded.withColumn("__place", place).filter(F.col("__place") <= share).drop("__place")
    left = n - taken.count()
    if left <= 0:
        return taken
    others = graded.withColumn("__place", place).filter((F.col("__place") > share) & (F.col("__place") <= share + left)).drop("__place")
    return taken.unionByName(others.orderBy(grade, key).limit(left))
