"""Sinks and scans of JSON and CSV files, with checks of what was written."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of a run's file, as nested JSON.
RUN = (
    "arm string, seed int, split_sha256 string, n_items int, accuracy double, ci_95 array<double>,"
    " latency struct<n:int,p50_s:double,p95_s:double,p99_s:double,mean_s:double>,"
    " per_subject map<string,struct<n:int,accuracy:double>>, device_occupancy struct<exclusive:boolean>,"
    " predictions array<struct<question_id:string,predicted_idx:int,option_logprobs:array<double>,prompt_tokens:int>>"
)

PASSAGE = ("id string, text string, corpus string, source_question_id string, title string")


def read_shards(spark: SparkSession, paths: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Chosen columns of several Parquet shards; others aren't read."""
    return spark.read.parquet(*paths).select(*columns)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run files of a folder, one JSON document each, with their names; a missing flag is exclusive."""
    rows = spark.read.schema(RUN).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    at = F.input_file_name()
    name = F.coalesce(F.nullif(F.regexp_extract(at, r"name=([^/]+)/", 1), F.lit("")), F.element_at(F.split(at, "/"), -1))
    return rows.withColumns({"file": name, "exclusive": F.coalesce("device_occupancy.exclusive", F.lit(True))})


def run_predictions(runs: DataFrame) -> DataFrame:
    """A row per prediction of each run."""
    return runs.select("arm", "seed", F.inline("predictions"))


def write_documents(rows: DataFrame, folder: str, *, name: str = "name") -> None:
    """One JSON document per row in a folder of its own, by the name; keys sorted, nulls kept."""
    columns = sorted(c for c in rows.columns if c != name)
    told = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows.select(name, told.alias("value")).repartition(name).write.mode("overwrite").partitionBy(name).text(folder)


#: The schema of a judged arm's file.
JUDGED = "arm string, judge_sd double, unparseable_replies int, items array<struct<item_id:string,scores:array<int>,majority:int,mean:double>>"


def read_judged(spark: SparkSession, folder: str, *, strict: bool = False) -> DataFrame:
    """arm, item_id, score of judged arms' files: half the mean grade, or with ``strict`` 1 for a majority of 2.

    Items without scores are left out.
    """
    rows = spark.read.schema(JUDGED).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    rows = rows.select("arm", F.inline("items")).filter(F.size(F.coalesce("scores", F.array().cast("array<int>"))) > 0)
    score = (F.col("majority") == 2).cast("double") if strict else F.col("mean") / 2
    return rows.select("arm", "item_id", score.alias("score"))


def write_frozen(lines: DataFrame, path: str) -> None:
    """Lines (value) of a frozen, small set as one file, in order."""
    lines.orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def read_frozen(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """The JSON lines of a frozen file, and the SHA-256 of its bytes, which names the split."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    digests = [r[0] for r in held.select(F.sha2("content", 256)).collect()]
    if len(digests) != 1:
        raise ValueError(f"{path} has {len(digests)} files; a frozen set is one")
    return spark.read.schema(schema).json(path), digests[0]


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per row, nulls kept."""
    rows.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def read_passages(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Passages from JSON lines; another number than expected is an error."""
    rows = spark.read.schema(PASSAGE).json(path)
    if expected is not None and (found := rows.count()) != expected:
        raise ValueError(f"{path} has {found} passages; {expected} are recorded")
    return rows


def write_sheet(rows: DataFrame, path: str, blank: Iterable[str] = ("human_label", "notes")) -> None:
    """A CSV sheet with empty columns for a human."""
    rows.withColumns({c: F.lit("") for c in blank}).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def read_sheet(spark: SparkSession, path: str, known: DataFrame, *, key: str = "question_id", score: str = "human_score") -> DataFrame:
    """Filled rows of a sheet whose key is known; blank scores and unknown keys are left out."""
    schema = (f"{key} string, question string, reference string, candidate string, {score} string, notes string")
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rows = rows.select(key, F.expr(f"try_cast(trim({score}) as int)").alias(score)).filter(F.col(score).isNotNull())
    return rows.join(known.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")


def write_lexicon(rows: DataFrame, path: str) -> None:
    """A reviewed lexicon (token, repair; a resource of hundreds of words) as one JSON object, keys sorted."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "repair"))))
    rows.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """A repair lexicon from a JSON object, its keys in lower case."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return {k.lower(): v for k, v in json.loads(text).items()}


def manifest_json(rows: DataFrame, **told: str | int) -> DataFrame:
    """One JSON text of recorded splits (split, n, digest) and what is told besides."""
    splits = F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("n", "digest")))))
    return rows.agg(F.to_json(F.struct(splits.alias("splits"), *[F.lit(v).alias(k) for k, v in sorted(told.items())])).alias("manifest"))


def read_settings(path: str, known: Mapping, section: str | None = None) -> dict:
    """Settings of a YAML or JSON file over their defaults; an absent file has the defaults.

    A section is used if the file has it, else the file as a whole. Unknown keys and files that
    aren't a mapping are refused.
    """
    if not os.path.isfile(path):
        return dict(known)
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        told = json.loads(text or "null")
    else:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError("YAML settings need the package yaml; JSON ones don't") from missing
        told = yaml.safe_load(text)
    if told is None:
        return dict(known)
    if not isinstance(told, dict):
        raise TypeError(f"{path} must hold a mapping, not a {type(told).__name__}")
    return settings(told.get(section, told) if section else told, known)


def settings(given: Mapping, known: Mapping) -> dict:
    """A section of settings over their defaults; unknown keys are refused."""
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**known, **given}
