"""Cleaning, first occurrences, leakage and mining of repair lexicons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..sources.scratch import store

OPTIONS = ("opa", "opb", "opc", "opd")

#: Repairs that a dictionary check would refuse, and ones that review refused.
OVERRIDES = {"aerial": "arterial", "aeries": "arteries", "aery": "artery"}
REJECTED = {"baer": "barter", "pas": "parts", "pos": "ports"}


#: Entries up to which a lexicon is sent to the tasks as a constant.
CONSTANT = 50_000


def repair_rows(rows: DataFrame, columns: list[str], lexicon: DataFrame, *, key: str = "id") -> DataFrame:
    """The rows with ``<column>_told``, a struct of the repaired text and the number of repairs, per column.

    A lexicon of up to ``CONSTANT`` entries is a constant hash table within the plan. A larger one
    is stored and joined: each row's distinct words meet it once, and a row is rebuilt with the few entries
    that it uses, in time that grows with its words alone. Rows without any aren't.

    Args:
        rows: key and the columns; rows of one key share their entries, which changes nothing.
        lexicon: token (lower case), repair; of several repairs of a token the least counts.
    """
    lexicon = lexicon.filter("token is not null and repair is not null").groupBy("token").agg(F.min("repair").alias("repair"))
    some = lexicon.limit(CONSTANT + 1).collect()
    if len(some) <= CONSTANT:
        found = tx.lookup(dict(some))
        return rows.withColumns({f"{c}_told": tx.repaired_by(F.col(c), found) for c in columns})
    lexicon = store(lexicon, "lexicon")
    words = F.concat(*[F.coalesce(tx.lower_words(F.col(c)), F.array().cast("array<string>")) for c in columns])
    used = rows.select(F.col(key).alias("__key"), F.explode(F.array_distinct(words)).alias("token")).join(lexicon, "token")
    used = used.groupBy("__key").agg(F.collect_set(F.struct("token", "repair")).alias("__used"))
    met = rows.join(used, F.col(key).eqNullSafe(F.col("__key")), "left")
    told = {f"{c}_told": tx.repaired_with(F.col(c), F.col("__used.token"), F.col("__used.repair")) for c in columns}
    return met.withColumns(told).drop("__key", "__used")


def checked_questions(rows: DataFrame, lexicon: Mapping[str, str] | DataFrame = OVERRIDES, *, drop_unlabelled: bool = True) -> DataFrame:
    """Normalise and repair multiple-choice rows, by a lexicon of any size, and say which are unfit: row by row.

    Args:
        rows: id, pos (the input order), question, opa to opd, cop (-1: no label), choice_type,
            exp and subject_name.

    Returns:
        the rows as id, pos, question, options, answer_idx, subject, explanation, hash, n_repaired,
        modified, multi and status: malformed, unlabelled or null, tested in this order.
    """
    fields = ("question", *OPTIONS, "exp")
    plain = {c: tx.blank_to_empty(F.col(c)) for c in fields}
    fixed = rows.withColumns({f"{c}_plain": v for c, v in plain.items()})
    if isinstance(lexicon, DataFrame):
        fixed = repair_rows(fixed, [f"{c}_plain" for c in fields], lexicon).withColumnsRenamed({f"{c}_plain_told": f"{c}_told" for c in fields})
    else:
        fixed = fixed.withColumns({f"{c}_told": tx.repair_counted(F.col(f"{c}_plain"), lexicon) for c in fields})
    fixed = fixed.withColumns({f"{c}_fixed": F.col(f"{c}_told.text") for c in fields})
    options = F.array(*[F.col(f"{c}_fixed") for c in OPTIONS])
    n_repaired = sum((F.col(f"{c}_told.n") for c in fields), F.lit(0))
    out = fixed.select(
        "id",
        "pos",
        F.col("question_fixed").alias("question"),
        options.alias("options"),
        F.nullif(F.col("cop"), F.lit(-1)).cast("int").alias("answer_idx"),
        F.coalesce("subject_name", F.lit("Unknown")).alias("subject"),
        F.nullif(F.col("exp_fixed"), F.lit("")).alias("explanation"),
        tx.content_hash(F.col("question_fixed"), options).alias("hash"),
        n_repaired.cast("long").alias("n_repaired"),
        (n_repaired > 0).alias("modified"),
        (F.col("choice_type") == "multi").alias("multi"),
        ((F.col("question_fixed") == "") | F.exists(options, lambda o: o == "")).alias("bad"),
    )
    unlabelled = F.col("answer_idx").isNull() & F.lit(drop_unlabelled)
    return out.withColumn("status", F.when(F.col("bad"), "malformed").when(unlabelled, "unlabelled")).drop("bad")


def clean_questions(rows: DataFrame, lexicon: Mapping[str, str] | DataFrame = OVERRIDES, *, drop_unlabelled: bool = True) -> DataFrame:
    """The rows of ``checked_questions``, with the status of fit ones: kept, the first by pos of its hash, or duplicate."""
    out = checked_questions(rows, lexicon, drop_unlabelled=drop_unlabelled)
    unfit = F.when(F.col("status").isNotNull(), F.col("pos"))  # these need no order, and may all have one hash
    first = F.row_number().over(W.partitionBy("hash", unfit).orderBy("pos"))
    return out.withColumn("status", F.coalesce("status", F.when(first > 1, "duplicate").otherwise("kept")))


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row of counts of ``clean_questions``."""
    of = lambda s: F.count_if(F.col("status") == s)
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        of("kept").alias("rows_kept"),
        F.count_if(F.col("modified") & (F.col("status") == "kept")).alias("rows_modified"),
        F.coalesce(F.sum("n_repaired"), F.lit(0)).alias("tokens_repaired"),
        of("duplicate").alias("duplicates_dropped"),
        of("unlabelled").alias("unlabelled_dropped"),
        of("malformed").alias("malformed_dropped"),
        F.count_if(F.col("multi")).alias("choice_type_normalised"),
    )


def first_by(rows: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")


def train_leakage(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Pairs (train_id, eval_id) of equal content hash (id, hash); of several eval rows the last id."""
    last = evaluation.groupBy("hash").agg(F.max("id").alias("eval_id"))
    return train.select(F.col("id").alias("train_id"), "hash").join(last, "hash").select("train_id", "eval_id")


def without_held_out(rows: DataFrame, banned: DataFrame) -> DataFrame:
    """Rows whose hash isn't banned."""
    return rows.join(banned.select("hash").distinct(), "hash", "left_anti")


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, n: occurrences of each word of letters."""
    return texts.select(F.explode(tx.alpha_words(F.col(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corpus_text(questions: DataFrame) -> DataFrame:
    """id, text: stem, options and explanation of each question as rows."""
    parts = F.concat(F.array("question"), "options", F.array("explanation"))
    return questions.select("id", F.explode(F.filter(parts, lambda p: p.isNotNull() & (p != ""))).alias("text"))


def propose_repairs(
    counts: DataFrame, dictionary: DataFrame, *, pairs: Iterable[str] = ("rt",), least: int = 20, length: int = 2, ratio: float = 0.3
) -> DataFrame:
    """Candidate repairs of words that lost a letter pair, for review.

    A word that isn't in the dictionary (word) is proposed if exactly one dictionary word results
    from putting a pair back, it occurs often enough, the right form does so too in proportion,
    and review hasn't refused it. The counts and the dictionary are read several times, so they should be stored.

    Returns:
        token, repair, pair, n, n_correct.
    """
    tokens = counts.filter((F.col("n") >= least) & (F.length("word") >= length))
    tokens = tokens.join(dictionary, "word", "left_anti").select(F.col("word").alias("token"), F.col("n"))
    ways = [F.struct(F.lit(p).alias("pair"), F.lit(i).alias("k"), tx.insertions(F.col("token"), p).alias("made")) for i, p in enumerate(pairs)]
    tried = tokens.select("token", "n", F.inline(F.array(*ways))).select("token", "n", "pair", "k", F.explode("made").alias("repair"))
    hits = tried.join(dictionary.select(F.col("word").alias("repair")).distinct(), "repair", "left_semi")
    found = hits.groupBy("token", "n").agg(
        F.min("repair").alias("repair"), F.max("repair").alias("other"), F.min_by("pair", "k").alias("pair")
    )
    found = found.filter("repair = other").drop("other")
    correct = counts.select(F.col("word").alias("repair"), F.col("n").alias("n_correct"))
    found = found.join(correct, "repair", "left").withColumn("n_correct", F.coalesce("n_correct", F.lit(0)))
    refused = F.lit(False)
    for token, repair in REJECTED.items():
        refused = refused | ((F.col("token") == token) & (F.col("repair") == repair))
    return found.filter((F.col("n_correct") >= ratio * F.col("n")) & ~refused).select("token", "repair", "pair", "n", "n_correct")


def build_lexicon(
    counts: DataFrame, dictionary: DataFrame, *, overrides: Mapping[str, str] = OVERRIDES, pairs: Iterable[str] = ("rt",), least: int = 20
) -> DataFrame:
    """Proposals for words of three letters or more, with their provenance; overrides always win.

    Returns:
        token, repair, pair (null for an override), n and n_correct (occurrences of both forms).
    """
    found = propose_repairs(counts, dictionary, pairs=pairs, least=least, length=3)
    fixed = counts.sparkSession.createDataFrame(sorted(overrides.items()), "token string, repair string")
    found = found.join(F.broadcast(fixed), "token", "left_anti")
    seen = lambda word, n: counts.select(F.col("word").alias(word), F.col("n").alias(n))
    told = F.broadcast(fixed).join(seen("token", "n"), "token", "left").join(seen("repair", "n_correct"), "repair", "left")
    told = told.withColumns({"pair": F.lit(None).cast("string"), "n": F.coalesce("n", F.lit(0)), "n_correct": F.coalesce("n_correct", F.lit(0))})
    return found.unionByName(told.select(*found.columns))
