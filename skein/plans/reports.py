"""Queries on names, formats, jobs, retrieval and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import clean, judging, report, retrieval, split, stats
from ..sources.tables import read_table
from . import standins as st
from .corpus import CLEANED, _cleaned, fold_sql
from .evaluation import ALL, ARMS, GROUND, ITEMS, RUNS, P, _grounded, _ok, _runs, boot_sql
from .registry import query

@query(f"""WITH {P}, uses(name, uses_adapter, corpus, headline) AS (VALUES {", ".join(str(r) for r in st.ARM_ROWS)})
SELECT name, corpus <> 'none' AS uses_retrieval, uses_adapter, headline, count(*) AS n FROM uses JOIN preds ON arm = name WHERE headline GROUP BY ALL""")
def arm_predicates(spark, sf_dir):
    """What the headline arms use, with their predictions' number."""
    uses = st.arm_rows(spark).filter("headline").select("arm", (F.col("corpus") != "none").alias("uses_retrieval"), "uses_adapter", "headline")
    rows = _ok(spark, sf_dir).join(F.broadcast(uses), "arm")
    return rows.groupBy(F.col("arm").alias("name"), "uses_retrieval", "uses_adapter", "headline").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P} SELECT arm, question_id, ['A', 'B', 'C', 'D'][answer_idx + 1] AS gold, ['A', 'B', 'C', 'D'][predicted_idx + 1] AS predicted, predicted_idx = answer_idx AS is_correct
FROM preds WHERE predicted_idx IS NOT NULL""")
def answer_labels(spark, sf_dir):
    labels = F.array(*map(F.lit, tx.LABELS))
    rows = st.predictions(spark, sf_dir).filter("predicted_idx is not null")
    return rows.select("arm", "question_id", F.get(labels, "answer_idx").alias("gold"), F.get(labels, "predicted_idx").alias("predicted"), (F.col("predicted_idx") == F.col("answer_idx")).alias("is_correct"))


@query(f"""WITH {P}, {st.QUESTIONS}, e AS (SELECT arm, question_id, ord, predicted_idx, preds.answer_idx, [opa, opb, opc, opd] AS options,
  CASE WHEN option_logs IS NOT NULL THEN 1 / list_sum(list_transform(option_logs, lambda x: exp(x - list_max(option_logs)))) END AS c FROM preds JOIN questions ON id = question_id)
SELECT question_id, CAST(ord AS INTEGER) AS place, arm, coalesce(['A', 'B', 'C', 'D'][predicted_idx + 1] || '. ' || options[predicted_idx + 1], '—') AS answered, coalesce(predicted_idx = answer_idx, false) AS correct,
  CASE WHEN predicted_idx = answer_idx THEN 'correct' ELSE 'wrong' END AS verdict, coalesce(printf('%.0f%%', 100 * c), '—') AS confidence, CAST(100 + question_id % 50 AS VARCHAR) AS prompt_tokens FROM e""")
def item_answers(spark, sf_dir):
    """Every arm's answer to every item as it is shown."""
    items = st.questions(spark, sf_dir).select(F.col("id").alias("question_id"), F.array(*clean.OPTIONS).alias("options"))
    preds = st.predictions(spark, sf_dir)
    answers = preds.select("arm", "question_id", "predicted_idx", F.array_max(sc.softmax(F.col("option_logs"))).alias("confidence"), (100 + F.col("question_id") % 50).alias("prompt_tokens"), "answer_idx")
    return report.answer_rows(items, answers, ARMS)


@query(f"""WITH {st.GOLD}, s AS (SELECT question_id, subject, {fold_sql("text")} AS stem FROM gold JOIN documents ON doc_id = question_id)
SELECT question_id, '[' || subject || '] ' || CASE WHEN length(stem) <= 90 THEN stem ELSE left(stem, 87) || '…' END AS label FROM s""")
def item_choices(spark, sf_dir):
    stems = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    return report.item_choices(st.gold(spark, sf_dir).join(stems, "question_id"))


@query(f"""WITH {CLEANED} SELECT id, count(*) AS n_texts, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM (
  SELECT id, unnest([question, opa, opb, opc, opd, exp]) AS t FROM cleaned WHERE status = 'kept') WHERE t <> '' GROUP BY id""")
def corpus_text_flatten(spark, sf_dir):
    rows = clean.corpus_text(_cleaned(spark, sf_dir).filter("status = 'kept'"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {st.GOLD} SELECT question_id, answer_idx FROM gold WHERE question_id IN (SELECT doc_id FROM documents WHERE {st.h('\"held\"', 'doc_id')} % 3 = 0)")
def gold_lookup(spark, sf_dir):
    frozen = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id")).filter(sc.draw("held", F.col("question_id")) % 3 == 0)
    return st.gold(spark, sf_dir).join(frozen, "question_id", "left_semi").select("question_id", "answer_idx")


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x0B]+$|^[\\s\\x0B]+', '', 'g'))), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, len(ls[1:4]) AS n_options, coalesce(trim(regexp_replace(ls[1], '^[A-Da-d][.):]\\s*', '')), '') AS first FROM s""")
def option_parser(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", tx.parse_options(F.col("text")).alias("o"))
    return rows.select("doc_id", F.size("o").cast("long").alias("n_options"), F.coalesce(F.get("o", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN substr(text, 1, 87) || '…' ELSE text END AS label FROM documents")
def picker_labels(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.picker_label(F.col("text")).alias("label"))


@query("SELECT doc_id, source || '_seed' || (n_chars % 9) AS stem, source AS arm, CAST(n_chars % 9 AS INTEGER) AS seed FROM documents")
def run_names(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", tx.run_stem(F.col("source"), F.col("n_chars") % 9).alias("stem"))
    return rows.select("doc_id", "stem", tx.run_arm(F.col("stem")).alias("arm"), tx.run_seed(F.col("stem")).alias("seed"))


@query("SELECT doc_id, strpos(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g'), 'all rights reserved') > 0 AS safe FROM documents")
def safety_phrases(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.holds_phrases(F.col("text"), ["All  rights reserved"]).alias("safe"))


@query("""SELECT doc_id, printf('%.1f', (n_chars % 1000) / 1000.0::DOUBLE * 100) || '%' AS pct, CASE WHEN (n_chars % 997) / 1e6 < 1e-4 THEN 'tiny' WHEN (n_chars % 997) / 1e6 < 1e-3 THEN printf('%.4f', (n_chars % 997)::DOUBLE / 1e6) ELSE 'large' END AS p FROM documents""")
def number_formats(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").withColumn("x", (F.col("n_chars") % 997) / F.lit(1e6))
    p = F.when(F.col("x") < 1e-4, "tiny").when(F.col("x") < 1e-3, tx.p_value(F.col("x"))).otherwise("large")
    return rows.select("doc_id", tx.percent((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("pct"), p.alias("p"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM e)
SELECT vec_id, round(greatest(v[1], v[3]) - z, 6) AS a, round(v[5] - z, 6) AS b FROM n""")
def option_log_softmax(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.select("vec_id", sc.option_logs(F.col("v"), [[0, 2], [4]]).alias("o"))
    return rows.select("vec_id", F.round(F.get("o", F.lit(0)), 6).alias("a"), F.round(F.get("o", F.lit(1)), 6).alias("b"))


RESULTS = f"""WITH {RUNS}, {GROUND.replace("g AS", "texts AS").replace("FROM g)", "FROM texts)")},
s AS (SELECT arm, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS sd, count(*) AS n FROM runs GROUP BY arm),
v AS (SELECT arm, CAST(ok AS DOUBLE) AS value FROM preds WHERE seed = 42), {boot_sql("v", "arm")},
tokens AS (SELECT arm, avg(100 + question_id % 50) AS prompt_tokens FROM preds WHERE seed = 42 GROUP BY arm),
uses(name, uses_adapter, corpus, headline) AS (VALUES {", ".join(str(r) for r in st.ARM_ROWS)}),
{st.LATENCIES}, samples AS (SELECT arm, seconds FROM latencies QUALIFY row_number() OVER (PARTITION BY arm ORDER BY seq) > 3),
speed AS (SELECT arm, quantile_cont(seconds, 0.5) AS p50, quantile_cont(seconds, 0.95) AS p95 FROM samples GROUP BY arm),
hits AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'external' ELSE 'parity' END AS corpus, avg(CAST(gold_cover >= 0.6 AS DOUBLE)) AS hit, avg(CAST(pred_cover >= 0.5 AS DOUBLE)) AS grounded FROM grounded GROUP BY 1)
SELECT runs.arm || CASE WHEN runs.arm = 'rag-external' THEN ' ⚠' ELSE '' END AS arm, printf('%.1f%%', 100 * accuracy) AS accuracy, printf('[%.1f, %.1f]', 100 * low, 100 * high) AS interval,
  printf('%.1f', 100 * mean) || ' ± ' || printf('%.1f', 100 * sd) || ' (n=' || s.n || ')' AS seeds, printf('%.0f ms', 1000 * p50) AS p50, printf('%.0f ms', 1000 * p95) AS p95,
  printf('%.0f', prompt_tokens) AS prompt_tokens, coalesce(printf('%.3f', hit), '—') AS retrieval_hit, coalesce(printf('%.3f', hits.grounded), '—') AS grounded
FROM runs JOIN s USING (arm) JOIN ends ON ends.g = runs.arm JOIN tokens USING (arm) JOIN uses ON name = runs.arm JOIN speed USING (arm) LEFT JOIN hits ON hits.corpus = uses.corpus WHERE seed = 42"""


def _results(spark, sf_dir):
    """What the main table tells of each arm, of runs on the same items."""
    preds = report.same_items(_ok(spark, sf_dir, st.SEEDS))
    runs = preds.groupBy("arm", "seed").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg(100 + F.col("question_id") % 50).alias("prompt_tokens"))
    spread = runs.groupBy("arm").agg(F.avg("accuracy").alias("mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n_seeds"))
    ends = stats.bootstrap(preds.filter("seed = 42").select("arm", F.col("question_id").alias("id"), F.col("ok").cast("double").alias("value"))).select("arm", "low", "high")
    uses = st.arm_rows(spark).withColumn("exclusive", F.col("arm") != "rag-external")
    speed = stats.latency_summary(st.latencies(spark, sf_dir)).select("arm", "p50", "p95")
    corpus = F.when(F.col("doc_id") % 2 == 0, "external").otherwise("parity")
    hits = _grounded(spark, sf_dir).groupBy(corpus.alias("corpus")).agg(
        F.avg((F.col("gold_cover") >= 0.6).cast("double")).alias("hit_rate"), F.avg((F.col("pred_cover") >= 0.5).cast("double")).alias("grounded_rate")
    )
    rows = stats.reference_run(runs)
    for few in (spread, ends, uses, speed):  # a row an arm
        rows = rows.join(F.broadcast(few), "arm")
    return rows.join(F.broadcast(hits), "corpus", "left")


@query(RESULTS)
def results_table(spark, sf_dir):
    return report.results_rows(_results(spark, sf_dir))


@query(f"SELECT t.* FROM ({RESULTS}) t WHERE replace(arm, ' ⚠', '') IN ({', '.join(repr(r[0]) for r in st.ARM_ROWS if r[3])})")
def results_headlines(spark, sf_dir):
    return report.results_rows(_results(spark, sf_dir), headline_only=True)


def tree_sql(rows: str, by: str, key: str) -> str:
    """CTEs of ``digests`` (g, n, digest): the digest of ids by group of a table, in leaves by their MD5."""
    return f"""leaves AS (SELECT {by} AS g, left(md5(CAST({key} AS VARCHAR)), 4) AS leaf, count(*) AS n, sha256(string_agg(CAST({key} AS VARCHAR), chr(10) ORDER BY CAST({key} AS VARCHAR))) AS d FROM {rows} WHERE {key} IS NOT NULL GROUP BY ALL),
knots AS (SELECT g, left(leaf, 2) AS knot, sum(n) AS n, sha256(string_agg(leaf || d, chr(10) ORDER BY leaf)) AS d FROM leaves GROUP BY ALL),
digests AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(knot || d, chr(10) ORDER BY knot)) AS digest FROM knots GROUP BY g)"""


@query(f"WITH {ALL}, runs AS (SELECT arm || '_' || seed AS run, question_id FROM preds), {tree_sql('runs', 'run', 'question_id')} SELECT count(*) AS n_runs, CASE WHEN count(DISTINCT digest) = 1 THEN min(digest) ELSE 'MIXED' END AS split FROM digests")
def provenance_note(spark, sf_dir):
    rows = _ok(spark, sf_dir, st.SEEDS).withColumn("run", F.concat_ws("_", "arm", F.col("seed").cast("string")))
    return report.provenance(split.tree_digest(rows, "run", key="question_id").withColumnRenamed("digest", "split_sha256"))


@query(f"WITH told AS (SELECT source, doc_id FROM documents), {tree_sql('told', 'source', 'doc_id')} SELECT g AS source, n, digest FROM digests")
def source_digests(spark, sf_dir):
    """A digest of the ids of every source, of any size."""
    return split.tree_digest(read_table(spark, sf_dir, "documents"), "source", key="doc_id")


@query(f"""WITH {ITEMS}, s AS (SELECT arm, question_id, mean / 2 AS graded, CAST(majority = 2 AS INTEGER) AS strict FROM items JOIN modes USING (arm, question_id)),
a AS (SELECT arm, avg(graded) AS graded, avg(strict) AS strict, count(*) AS n FROM s GROUP BY arm)
SELECT arm, n, round(graded, 9) AS graded, round(strict, 9) AS strict, row_number() OVER (ORDER BY graded DESC, arm) = 1 AS best FROM a""")
def freetext_arms_table(spark, sf_dir):
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    per = rows.groupBy("arm").agg(F.avg("graded").alias("graded"), F.avg("strict").alias("strict"), F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(W.orderBy(F.col("graded").desc(), "arm")) == 1
    return per.select("arm", "n", F.round("graded", 9).alias("graded"), F.round("strict", 9).alias("strict"), best.alias("best"))


@query(f"""WITH {ITEMS}, s AS (SELECT arm, question_id, CAST(majority = 2 AS INTEGER) AS strict FROM modes), b AS (SELECT question_id, strict AS base FROM s WHERE arm = 'base')
SELECT arm, count(*) AS n, CAST(sum(strict - base) AS BIGINT) AS total, count(*) FILTER (strict > base) AS higher, count(*) FILTER (strict < base) AS lower FROM s JOIN b USING (question_id) WHERE arm <> 'base' GROUP BY arm""")
def freetext_deltas(spark, sf_dir):
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    base = rows.filter("arm = 'base'").select("question_id", F.col("strict").alias("base"))
    d = F.col("strict") - F.col("base")
    rows = rows.filter("arm != 'base'").join(base, "question_id")
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"), F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"))


@query(f"WITH {st.GOLD}, p AS (SELECT question_id, row_number() OVER (ORDER BY question_id DESC) AS back FROM gold) SELECT question_id, CASE WHEN back <= 50 THEN 'val' ELSE 'train' END AS split FROM p")
def tail_split(spark, sf_dir):
    rows = retrieval.numbered(st.gold(spark, sf_dir).select("question_id"), "question_id")
    n = rows.agg(F.max("index").alias("last"))
    return rows.crossJoin(F.broadcast(n)).select("question_id", F.when(F.col("index") > F.col("last") - 50, "val").otherwise("train").alias("split"))


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS query FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, query), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
t AS (SELECT query_id, rank, r.vec_id, text FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE score >= 0),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS cum, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM t)
SELECT query_id, vec_id FROM c WHERE place = 1 OR cum <= 3000""")
def retrieve(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = retrieval.top_k(q, v, 5, least=0.0)
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return retrieval.within_budget(top.join(texts, "vec_id"), 3000).select("query_id", "vec_id")


@query("""WITH j AS (SELECT o_orderpriority AS grp, o_orderkey AS pos FROM orders), r(grp, rank) AS (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2))
SELECT pos, row_number() OVER (ORDER BY coalesce(rank, 3), pos) AS place FROM j LEFT JOIN r USING (grp)""")
def job_queue(spark, sf_dir):
    jobs = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("pos"))
    rows = report.queue_order(jobs, {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2})
    return rows.select("pos", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_artifacts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id").exceptAll(read_table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def concatenated_corpora(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.unionByName(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(f"""WITH {P}, ok AS (SELECT arm, question_id FROM preds WHERE ok) SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n FROM ok a JOIN ok b ON a.question_id = b.question_id AND a.arm < b.arm GROUP BY ALL""")
def shared_ids(spark, sf_dir):
    rows = stats.mcnemar_counts(_ok(spark, sf_dir).filter("ok"), sorted(ARMS))
    return rows.select("arm_a", "arm_b", "n")
