"""Places for callables of the user: judges over HTTP and encoders, a batch at a time."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import commits
from ..sources.scratch import forget, new_path, store


def judge_replies(
    prompts: DataFrame, make_judge: Callable[[], Callable[[str, int], str]], *, seeds: tuple[int, ...] = (0, 1, 2), retries: int = 3, wait: float = 0.5
) -> DataFrame:
    """Ask a judge for each prompt (item_id, prompt) and seed.

    ``make_judge`` runs once a task. A call that raises is tried again after a wait that doubles;
    after the last failure the reply is null. Rows keep their item and seed, so that the order of
    tasks doesn't matter.

    Returns:
        item_id, seed, reply, tries.
    """
    rows = prompts.select("item_id", "prompt", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    return _asked(rows, make_judge, retries=retries, wait=wait)


def _asked(rows: DataFrame, make_judge: Callable[[], Callable[[str, int], str]], *, retries: int, wait: float, workers: int = 1) -> DataFrame:
    """item_id, seed, reply, tries of rows (item_id, prompt, seed), by so many threads a task."""
    kind = rows.schema["item_id"].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()

        def one(item, prompt: str, seed: int) -> tuple:
            reply, tries = None, 0
            while reply is None and tries <= retries:
                if tries:
                    time.sleep(wait * 2 ** (tries - 1))
                tries += 1
                try:
                    reply = judge(prompt, seed)
                except Exception:  # the caller's transport may raise anything
                    reply = None
            return item, seed, reply, tries

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                out = list(pool.map(one, batch["item_id"], batch["prompt"], map(int, batch["seed"])))
                yield pd.DataFrame(out, columns=["item_id", "seed", "reply", "tries"])

    return rows.mapInPandas(ask, f"item_id {kind}, seed int, reply string, tries int")


def http_transport(url: str, payload: dict, timeout: float = 120.0) -> dict:
    """Post JSON and read the JSON reply."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def http_judge(
    base_url: str, model: str, *, system: str = "", temperature: float = 0.0, max_tokens: int = 256, transport: Callable[[str, dict], dict] = http_transport
) -> Callable[[], Callable[[str, int], str]]:
    """A maker of judges, for ``judge_replies``, that ask a chat completion endpoint.

    What the transport raises, and a reply without a message, is raised to the caller, who tries
    again.
    """

    def make() -> Callable[[str, int], str]:
        def judge(prompt: str, seed: int) -> str:
            said = [{"role": "system", "content": system}] if system else []
            said.append({"role": "user", "content": prompt})
            payload = {"model": model, "messages": said, "temperature": temperature, "max_tokens": max_tokens, "seed": seed}
            return transport(f"{base_url.rstrip('/')}/chat/completions", payload)["choices"][0]["message"]["content"]

        return judge

    return make


#: Texts that a task encodes, and replies that it asks for, before they are written.
TEXTS, ASKED = 4096, 256


def store_vectors(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], object]], path: str, *, prefix: str = "", model: str = "") -> DataFrame:
    """Add the vectors of texts (id, text) to a store and read them, checked; what is stored already isn't encoded again.

    A vector is stored by the SHA-256 of model, prefix and text, so equal texts are encoded once. Each
    task encodes ``TEXTS`` texts and its file stays when the run ends early; the next run encodes
    the rest. The ids come last, with a manifest. No texts, or vectors of unequal lengths, are an error.

    Args:
        model: names the encoder; another one's vectors are kept apart.
    """
    spark = texts.sparkSession
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    key = F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(prefix), "text"), 256)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    if rows.isEmpty():
        raise ValueError("there are no texts to embed")
    absent = rows.select(F.col("key").alias("id"), "text").dropDuplicates(["id"])
    absent = absent.join(commits.logged(spark, f"{path}/vectors", kind).select(F.col("key").alias("id")), "id", "left_anti")
    if n := absent.count():
        made = embed(absent.repartition(-(-n // TEXTS), "id"), make_encoder, prefix=prefix)
        commits.append(made.select(F.col("id").alias("key"), "embedding"), f"{path}/vectors")
    commits.commit(rows.select("id", "key"), f"{path}/ids", facts={"model": model, "prefix": prefix})
    return read_vectors(spark, path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding of a finished store; one without a manifest, an id without a vector and unequal lengths are errors."""
    ids = commits.read(spark, f"{path}/ids")
    vectors = spark.read.parquet(f"{path}/vectors").dropDuplicates(["key"])
    rows = ids.join(vectors, "key", "left").select("id", "embedding")
    n, absent, widths = rows.agg(F.count(F.lit(1)), F.count_if(F.col("embedding").isNull()), F.count_distinct(F.size("embedding"))).first()
    if absent or widths > 1:
        raise ValueError(f"{path}: {absent} of {n} vectors are missing; there are {widths} lengths")
    return rows


#: What is logged of a call of a judge.
REPLIES = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("rubric", T.StringType()),
    T.StructField("reply", T.StringType()), T.StructField("tries", T.IntegerType()),
])


def judge_durably(
    prompts: DataFrame, make_judge: Callable[[], Callable[[str, int], str]], log: str, *, rubric: str, seeds: tuple[int, ...] = (0, 1, 2),
    tasks: int = 8, workers: int = 1, retries: int = 3, wait: float = 0.5,
) -> DataFrame:
    """Ask a judge for each prompt (item_id, prompt) and seed that the log has no reply to, and give all replies.

    Replies are logged by the SHA-256 of item and prompt, by seed and by the rubric's version, so that a
    changed prompt or rubric is asked anew and nothing else is. Questions are asked in waves of
    ``tasks`` times ``ASKED``: a task's replies are logged once it ends, and of a run that ends early
    one wave at most is asked again. At most ``tasks`` times ``workers`` calls run at a time,
    on all executors together. A question that failed is logged without a reply, and asked in the next run.

    Returns:
        item_id, seed, reply (null if no call succeeded), calls (how often it was logged).
    """
    spark = prompts.sparkSession
    key = F.sha2(F.concat_ws("\x00", F.col("item_id").cast("string"), "prompt"), 256)
    asked = prompts.select("item_id", "prompt", key.alias("key"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    told = lambda: commits.logged(spark, log, REPLIES).filter(F.col("rubric") == rubric)
    absent = asked.select("key", "prompt", "seed").dropDuplicates(["key", "seed"]).join(told().filter("reply is not null"), ["key", "seed"], "left_anti")
    absent = store(absent, "asked")  # the log grows meanwhile
    if waves := -(-absent.count() // (tasks * ASKED)):
        # A wave has a folder of its own, so that it reads its own questions alone.
        dealt = absent.withColumn("wave", F.pmod(F.xxhash64("key", "seed"), F.lit(waves)).cast("int"))
        dealt.repartition("wave").write.partitionBy("wave").parquet(path := new_path(spark, "waves"))
        for (wave,) in sorted(dealt.select("wave").distinct().collect()):
            some = spark.read.schema(absent.schema).parquet(f"{path}/wave={wave}")
            rows = some.select(F.col("key").alias("item_id"), "prompt", "seed").repartition(tasks)
            made = _asked(rows, make_judge, retries=retries, wait=wait, workers=workers)
            commits.append(made.select(F.col("item_id").alias("key"), "seed", F.lit(rubric).alias("rubric"), "reply", "tries"), log)
    forget(absent)
    replies = told().groupBy("key", "seed").agg(F.min("reply").alias("reply"), F.count(F.lit(1)).alias("calls"))
    return asked.join(replies, ["key", "seed"]).select("item_id", "seed", "reply", "calls")


def embed(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], object]], *, prefix: str = "") -> DataFrame:
    """Vectors of texts (id, text) by an encoder that is made once a task; queries may need a prefix.

    Returns:
        id, embedding.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            vectors = encoder([prefix + t for t in batch["text"]])
            yield pd.DataFrame({"id": batch["id"], "embedding": [[float(x) for x in v] for v in vectors]})

    return texts.select("id", "text").mapInPandas(encode, f"id {kind}, embedding array<float>")
