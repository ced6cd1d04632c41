"""Inputs derived from the tables: questions, predictions, judgements and costs.

Each has a Spark form and a SQL form of the same rows. Draws are the first hex digits of MD5s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import draw
from ..operators.report import fixed_costs
from ..operators.selection import percentiles
from ..sources.tables import read_table

#: Arms in their order with the accuracy in percent that their predictions are drawn for.
ARMS = {"base": 57, "rag-external": 57, "qlora": 63, "qlora-rag": 61, "rag-parity": 67, "qlora-rag-parity": 71}
SEEDS = (42, 43, 44)
WORD = "[^ \\t\\n\\r\\f\\x0B]+"
#: What holds the first seven words, of which options are made.
HEAD = "^(?:[ \\t\\n\\r\\f\\x0B]*+[^ \\t\\n\\r\\f\\x0B]++){0,7}+"

#: A published rate card and its volumes; chunks of 600 characters embedded and rows trained on in a second.
GPU_HOUR = 0.40
VOLUMES = (100, 1000, 10000, 100000, 1000000, 10000000)
CHUNKS_A_SECOND, ROWS_A_SECOND = 248.0, 1.65

#: The arms with what they use: adapter, corpus, and whether they are headlines.
ARM_ROWS = (
    ("base", False, "none", True), ("rag-external", False, "external", True), ("qlora", True, "none", True),
    ("qlora-rag", True, "external", True), ("rag-parity", False, "parity", False), ("qlora-rag-parity", True, "parity", False),
)


def h(*parts: str) -> str:
    """The SQL of ``draw``: strings in double quotes are literals, others expressions."""
    said = " || '|' || ".join("'" + p[1:-1] + "'" if p[0] == '"' else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({said}), 1, 8))::UBIGINT AS BIGINT)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice rows from all documents; every tenth has no label, by hash."""
    d = read_table(spark, sf_dir, "documents")
    ws = F.regexp_extract_all(F.regexp_extract("text", HEAD, 0), F.lit(WORD), F.lit(0))
    rows = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", "source", ws.alias("ws"))
    return rows.select(
        "id", "pos", F.col("text").alias("question"),
        *[F.coalesce(F.get("ws", F.lit(i)), F.lit("")).alias(c) for c, i in (("opa", 0), ("opb", 2), ("opc", 4), ("opd", 6))],
        F.when(draw("cop", F.col("id")) % 10 == 0, -1).otherwise(draw("gold", F.col("id")) % 4).cast("int").alias("cop"),
        F.when(draw("multi", F.col("id")) % 5 == 0, "multi").otherwise("single").alias("choice_type"),
        F.concat(F.lit("The aery and HEA. "), F.col("text")).alias("exp"), F.col("source").alias("subject_name"),
    )


QUESTIONS = rf"""questions AS (
  SELECT doc_id AS id, doc_id AS pos, text AS question,
    coalesce(ws[1], '') AS opa, coalesce(ws[3], '') AS opb, coalesce(ws[5], '') AS opc, coalesce(ws[7], '') AS opd,
    CASE WHEN {h('"cop"', "doc_id")} % 10 = 0 THEN -1 ELSE {h('"gold"', "doc_id")} % 4 END AS cop,
    CASE WHEN {h('"multi"', "doc_id")} % 5 = 0 THEN 'multi' ELSE 'single' END AS choice_type,
    'The aery and HEA. ' || text AS exp, source AS subject_name
  FROM (SELECT *, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS ws FROM documents))"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, subject, answer_idx of all labelled documents."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = read_table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id")
    return rows.select(F.col("doc_id").alias("question_id"), F.col("source").alias("subject"), (draw("gold", F.col("doc_id")) % 4).cast("int").alias("answer_idx"))


GOLD = f"""gold AS (SELECT l.doc_id AS question_id, d.source AS subject, CAST({h('"gold"', "l.doc_id")} % 4 AS INTEGER) AS answer_idx
  FROM labels l JOIN documents d USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str, seeds=SEEDS[:1]) -> DataFrame:
    """arm, seed, question_id, subject, answer_idx, predicted_idx (some null), option_logs."""
    arms = F.array(*[F.struct(F.lit(k).alias("arm"), F.lit(v).alias("acc")) for k, v in ARMS.items()])
    rows = gold(spark, sf_dir).select("*", F.inline(arms))
    rows = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    key = (F.col("arm"), F.col("seed"), F.col("question_id"))
    wrong = (F.col("answer_idx") + 1 + draw("w", *key) % 3) % 4
    rows = rows.withColumn(
        "predicted_idx",
        F.when(draw("none", *key) % 50 == 0, None).when(draw(*key) % 100 < F.col("acc"), F.col("answer_idx")).otherwise(wrong).cast("int"),
    )
    logs = [F.when(F.col("predicted_idx") == i, 0.0).otherwise(-(1 + draw("l", *key, F.lit(i)) % 300) / 100.0) for i in range(4)]
    return rows.withColumn("option_logs", F.when(F.col("predicted_idx").isNotNull(), F.array(*logs))).drop("acc")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def predictions_sql(seeds=SEEDS[:1]) -> str:
    key = ("arm", "seed", "question_id")
    logs = ", ".join(
        f"CASE WHEN predicted_idx = {i} THEN 0.0::DOUBLE ELSE -(1 + {h(chr(34) + 'l' + chr(34), *key, str(i))} % 300) / 100.0::DOUBLE END" for i in range(4)
    )
    return f"""{GOLD},
arms(arm, acc, ord) AS (VALUES {_values((k, v, i) for i, (k, v) in enumerate(ARMS.items(), 1))}),
drawn AS (SELECT arm, seed, question_id, subject, answer_idx, ord,
    CASE WHEN {h('"none"', *key)} % 50 = 0 THEN NULL WHEN {h(*key)} % 100 < acc THEN answer_idx
         ELSE CAST((answer_idx + 1 + {h('"w"', *key)} % 3) % 4 AS INTEGER) END AS predicted_idx
  FROM gold, arms, (VALUES {_values((s,) for s in seeds)}) s(seed)),
preds AS (SELECT *, CASE WHEN predicted_idx IS NOT NULL THEN [{logs}] END AS option_logs,
    coalesce(predicted_idx = answer_idx, false) AS ok FROM drawn)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, question_id, seed, reply: a judge's replies in three seeds, some without a grade."""
    arms = F.array(*map(F.lit, ARMS))
    rows = gold(spark, sf_dir).select("question_id", F.explode(arms).alias("arm")).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key = (F.col("arm"), F.col("question_id"))
    grade = F.when(draw("noise", *key, F.col("seed")) % 6 == 0, draw("k", *key, F.col("seed")) % 3).otherwise(draw("k", *key) % 3)
    said = F.concat(F.lit("Reasoning. score : "), grade.cast("string"))
    return rows.select("arm", "question_id", "seed", F.when(draw("bad", *key, F.col("seed")) % 10 == 0, "no grade").otherwise(said).alias("reply"))


REPLIES = f"""{GOLD},
arms(arm, ord) AS (VALUES {_values((k, i) for i, k in enumerate(ARMS, 1))}),
replies AS (SELECT arm, question_id, seed,
    CASE WHEN {h('"bad"', "arm", "question_id", "seed")} % 10 = 0 THEN 'no grade' ELSE 'Reasoning. score : ' ||
      CASE WHEN {h('"noise"', "arm", "question_id", "seed")} % 6 = 0 THEN {h('"k"', "arm", "question_id", "seed")} % 3
           ELSE {h('"k"', "arm", "question_id")} % 3 END END AS reply
  FROM gold, arms, (VALUES (0), (1), (2)) s(seed)),
scores AS (SELECT arm, question_id, seed, TRY_CAST(nullif(regexp_extract(reply, '(?i)SCORE\\s*:\\s*([0-2])', 1), '') AS INTEGER) AS score FROM replies)"""


def arm_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARM_ROWS, "arm string, uses_adapter boolean, corpus string, headline boolean")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, seq, seconds: every event is a query of an arm, by its number."""
    names = F.array(*map(F.lit, sorted(ARMS)))
    rows = read_table(spark, sf_dir, "events")
    return rows.select(F.get(names, (F.col("event_id") % len(ARMS)).cast("int")).alias("arm"), F.col("event_id").alias("seq"), (F.col("value") / 1000).alias("seconds"))


LATENCIES = f"""latencies AS (SELECT ([{", ".join(repr(a) for a in sorted(ARMS))}])[event_id % {len(ARMS)} + 1] AS arm, event_id AS seq, value / 1000 AS seconds FROM events)"""


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, embed_gpu_seconds: the documents of even number are an external corpus, the others the parity one."""
    corpus = F.when(F.col("doc_id") % 2 == 0, "external").otherwise("parity")
    chunks = F.sum(F.ceil(F.col("n_chars") / 600))
    return read_table(spark, sf_dir, "documents").groupBy(corpus.alias("corpus")).agg((chunks / CHUNKS_A_SECOND).alias("embed_gpu_seconds"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_gpu_seconds: one row, by the labelled rows."""
    return read_table(spark, sf_dir, "labels").agg((F.count(F.lit(1)) / ROWS_A_SECOND).alias("train_gpu_seconds"))


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, fixed_s, query_s: seconds of training and index, and the median of a query's."""
    speed = percentiles(latencies(spark, sf_dir), {"p50_s": 0.5}, by="arm", value="seconds").drop("n")
    return fixed_costs(arm_rows(spark).join(F.broadcast(speed), "arm"), corpora(spark, sf_dir), training(spark, sf_dir))


COSTS_SQL = f"""uses(name, uses_adapter, corpus, headline) AS (VALUES {", ".join(str(r) for r in ARM_ROWS)}), {LATENCIES},
built AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'external' ELSE 'parity' END AS corpus, sum(ceil(n_chars / 600)) / {CHUNKS_A_SECOND}::DOUBLE AS s FROM documents GROUP BY 1),
costs AS (SELECT name AS arm, CASE WHEN uses_adapter THEN (SELECT count(*) / {ROWS_A_SECOND}::DOUBLE FROM labels) ELSE 0 END + coalesce(s, 0) AS fixed_s, query_s
  FROM uses LEFT JOIN built USING (corpus) JOIN (SELECT arm, quantile_cont(seconds, 0.5) AS query_s FROM latencies GROUP BY arm) ON arm = name)"""


def pairs_by_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs: a user turn and the assistant's next one; the conversation is the passage."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = u.join(a, ["conv_id", "turn"])
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select(key.alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("conv_id").alias("passage"), "question", "answer")


PAIRS = """pairs AS (SELECT u.conv_id || '-' || u.turn AS id, u.conv_id * 1000 + u.turn AS pos, u.conv_id AS passage,
    u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
