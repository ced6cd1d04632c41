"""Queries on predictions, judgements, probes and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import judging, report, split, stats
from ..operators.selection import hinted
from ..sources.tables import read_table
from . import standins as st
from .registry import query

P = st.predictions_sql()
ALL = st.predictions_sql(st.SEEDS)
ARMS = list(st.ARMS)


def _ok(spark, sf_dir, seeds=st.SEEDS[:1]):
    """Predictions with ok; an abstention counts as wrong."""
    rows = st.predictions(spark, sf_dir, seeds)
    return rows.withColumn("ok", F.coalesce(F.col("predicted_idx") == F.col("answer_idx"), F.lit(False)))


PAIRED = f"""{P}, met AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.ok AS x, b.ok AS y FROM preds a JOIN preds b ON a.question_id = b.question_id AND a.ord < b.ord),
tests AS (SELECT arm_a, arm_b, count(*) AS n, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (y AND NOT x) AS b_only,
  avg(CAST(x AS DOUBLE)) - avg(CAST(y AS DOUBLE)) AS delta FROM met GROUP BY arm_a, arm_b)"""


@query(f"""WITH {PAIRED} SELECT arm_a, arm_b, n, a_only, b_only, round(delta, 9) AS delta,
  round(CASE WHEN a_only + b_only >= 25 THEN pow(abs(a_only - b_only) - 1, 2) / (a_only + b_only) END, 9) AS statistic,
  CASE WHEN a_only + b_only < 25 THEN 'mcnemar-exact' ELSE 'mcnemar-chi2' END AS method FROM tests""")
def paired_mcnemar(spark, sf_dir):
    made = stats.mcnemar(stats.mcnemar_counts(_ok(spark, sf_dir), ARMS))
    return made.select("arm_a", "arm_b", "n", "a_only", "b_only", F.round("delta", 9).alias("delta"), F.round("statistic", 9).alias("statistic"), "method")


@query(f"WITH {P} SELECT arm, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS accuracy FROM preds GROUP BY arm")
def arm_accuracy(spark, sf_dir):
    return _ok(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


@query(f"""WITH {P} SELECT arm, subject, count(*) AS n, avg(CAST(predicted_idx = answer_idx AS DOUBLE)) AS accuracy
FROM preds WHERE predicted_idx IS NOT NULL GROUP BY arm, subject""")
def per_subject_accuracy(spark, sf_dir):
    return report.per_subject(st.predictions(spark, sf_dir).withColumn("ok", F.col("predicted_idx") == F.col("answer_idx")))


@query(f"""WITH {P}, s AS (SELECT arm, subject, count(*) AS n, avg(CAST(predicted_idx = answer_idx AS DOUBLE)) AS acc FROM preds WHERE predicted_idx IS NOT NULL GROUP BY ALL)
SELECT subject, max(n) AS n, {", ".join(f"max(acc) FILTER (arm = '{a}') AS " + a.replace("-", "_") for a in ARMS)} FROM s GROUP BY subject HAVING max(n) >= 20""")
def per_subject_pivot(spark, sf_dir):
    rows = report.per_subject(st.predictions(spark, sf_dir).withColumn("ok", F.col("predicted_idx") == F.col("answer_idx")))
    sizes = rows.groupBy("subject").agg(F.max("n").alias("n")).filter("n >= 20")
    return report.pivot(rows, "subject", ARMS, "accuracy").join(sizes, "subject").withColumnsRenamed({a: a.replace("-", "_") for a in ARMS})


RUNS = f"{ALL}, runs AS (SELECT arm, seed, avg(CAST(ok AS DOUBLE)) AS accuracy FROM preds GROUP BY arm, seed)"


@query(f"WITH {RUNS} SELECT arm, count(*) AS n, round(avg(accuracy), 9) AS mean, round(coalesce(stddev_samp(accuracy), 0), 9) AS sd FROM runs GROUP BY arm")
def seed_variance(spark, sf_dir):
    rows = _runs(spark, sf_dir).groupBy("arm")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 9).alias("sd"))


def _runs(spark, sf_dir):
    return _ok(spark, sf_dir, st.SEEDS).groupBy("arm", "seed").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


@query(f"WITH {RUNS} SELECT * FROM runs WHERE seed = 42")
def reference_seed_pick(spark, sf_dir):
    return stats.reference_run(_runs(spark, sf_dir))


def boot_sql(rows: str, by: str) -> str:
    """CTEs of ``ends`` (g, low, high): the Poisson bootstrap of ``value`` by group of a table."""
    return f"""cells AS (SELECT {by} AS g, CAST(round(value * 1000000000) AS BIGINT) AS nano, count(*) AS c FROM {rows} WHERE value IS NOT NULL GROUP BY ALL),
parts AS MATERIALIZED (SELECT g, nano, power, 0 AS part FROM cells, range(0, 20) t(power) WHERE (c >> power) & 1 = 1 UNION ALL SELECT g, nano, 20, unnest(range(0, c >> 20)) FROM cells),
means_of AS (SELECT range AS power, pow(2, range) AS mean FROM range(0, 21)),
shares AS (SELECT power, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY power ORDER BY k) AS s FROM (
  SELECT *, unnest(range(CAST(greatest(0, floor(mean - 8 * sqrt(mean)) - 10) AS BIGINT), CAST(floor(mean + 8 * sqrt(mean)) AS BIGINT) + 13)) AS k FROM means_of)),
steps AS MATERIALIZED (SELECT * FROM (SELECT power, k, lag(high, 1, 0) OVER (PARTITION BY power ORDER BY k) AS low, high FROM (
  SELECT power, k, CASE WHEN k = max(k) OVER (PARTITION BY power) THEN 4294967296 ELSE least(CAST(floor(s * 4294967296) AS BIGINT), 4294967296) END AS high FROM shares)) WHERE low < high),
rounds AS MATERIALIZED (SELECT g, nano, power, {st.h('"boot"', "42", "g", "nano", "power", "part", "b")} AS d, b FROM parts, range(0, 10000) t(b)),
resampled AS (SELECT g, b, sum(k * nano / 1000000000) / nullif(sum(k), 0) AS m FROM rounds ASOF JOIN steps ON rounds.power = steps.power AND d >= low GROUP BY g, b),
ends AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM resampled GROUP BY g)"""


@query(f"""WITH {P}, v AS (SELECT arm, CAST(ok AS DOUBLE) AS value FROM preds), {boot_sql("v", "arm")}
SELECT arm, n, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT arm, count(*) AS n, avg(value) AS mean FROM v GROUP BY arm) JOIN ends ON g = arm""")
def bootstrap_ci(spark, sf_dir):
    values = _ok(spark, sf_dir).select("arm", F.col("question_id").alias("id"), F.col("ok").cast("double").alias("value"))
    return stats.bootstrap(values, resamples=10_000).select("arm", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("""WITH s AS (SELECT event_type AS arm, value / 1000 AS seconds FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 3)
SELECT arm, count(*) AS n, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95, round(quantile_cont(seconds, 0.99), 6) AS p99,
  round(avg(seconds), 6) AS mean, round(min(seconds), 6) AS min, round(max(seconds), 6) AS max FROM s GROUP BY arm""")
def latency_percentiles(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.struct("ts", "event_id").alias("seq"), (F.col("value") / 1000).alias("seconds"))
    made = stats.latency_summary(rows)
    return made.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean", "min", "max")])


@query(f"""WITH {P} SELECT arm, question_id, list_position(option_logs, list_max(option_logs)) - 1 AS predicted,
  round(CASE WHEN option_logs IS NULL THEN 0 ELSE list_sort(option_logs, 'DESC')[1] - list_sort(option_logs, 'DESC')[2] END, 9) AS margin FROM preds WHERE option_logs IS NOT NULL""")
def option_argmax_margin(spark, sf_dir):
    rows = st.predictions(spark, sf_dir).filter("option_logs is not null")
    return rows.select("arm", "question_id", sc.argmax(F.col("option_logs")).alias("predicted"), F.round(sc.margin(F.col("option_logs")), 9).alias("margin"))


@query(f"""WITH {P}, e AS (SELECT arm, question_id, list_transform(option_logs, lambda x: exp(x - list_max(option_logs))) AS es FROM preds WHERE option_logs IS NOT NULL)
SELECT arm, question_id, round(es[1] / list_sum(es), 9) AS a, round(es[2] / list_sum(es), 9) AS b, round(es[3] / list_sum(es), 9) AS c, round(es[4] / list_sum(es), 9) AS d FROM e""")
def option_softmax(spark, sf_dir):
    rows = st.predictions(spark, sf_dir).filter("option_logs is not null").select("arm", "question_id", sc.softmax(F.col("option_logs")).alias("s"))
    return rows.select("arm", "question_id", *[F.round(F.get("s", F.lit(i)), 9).alias(c) for i, c in enumerate("abcd")])


CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")))"
GROUND = f"""g AS (SELECT doc_id, {CONTENT.format("text")} AS ctx, {CONTENT.format("wa")} AS gold, {CONTENT.format("wb")} AS pred FROM (
  SELECT d.doc_id, d.text, b.text AS wa, d.source || ' ' || d.lang || ' ' || b.text AS wb FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))),
grounded AS (SELECT doc_id, CASE WHEN len(gold) = 0 THEN 0 ELSE len(list_intersect(gold, ctx)) / len(gold)::DOUBLE END AS gold_cover,
  CASE WHEN len(pred) = 0 THEN 0 ELSE len(list_intersect(pred, ctx)) / len(pred)::DOUBLE END AS pred_cover FROM g)"""


def _grounded(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    d = read_table(spark, sf_dir, "documents").crossJoin(F.broadcast(n))
    rows = d.join(hinted(b.withColumnRenamed("text", "wa")), F.col("item_id") == F.col("doc_id") % F.col("n"))
    rows = rows.select("doc_id", tx.content_words(F.col("text")).alias("ctx"), tx.content_words(F.col("wa")).alias("gold"),
                       tx.content_words(F.concat_ws(" ", "source", "lang", "wa")).alias("pred"))
    return rows.select("doc_id", sc.overlap_share(F.col("ctx"), F.col("gold")).alias("gold_cover"), sc.overlap_share(F.col("ctx"), F.col("pred")).alias("pred_cover"))


@query(f"""WITH {GROUND} SELECT doc_id, round(gold_cover, 9) AS gold_cover, round(pred_cover, 9) AS pred_cover, gold_cover >= 0.6 AS hit, pred_cover >= 0.5 AS grounded FROM grounded""")
def groundedness_items(spark, sf_dir):
    rows = _grounded(spark, sf_dir)
    return rows.select("doc_id", F.round("gold_cover", 9).alias("gold_cover"), F.round("pred_cover", 9).alias("pred_cover"), (F.col("gold_cover") >= 0.6).alias("hit"), (F.col("pred_cover") >= 0.5).alias("grounded"))


@query(f"""WITH {GROUND} SELECT count(*) AS n, round(avg(CAST(gold_cover >= 0.6 AS DOUBLE)), 9) AS hit_rate, round(avg(CAST(pred_cover >= 0.5 AS DOUBLE)), 9) AS grounded_rate,
  round(avg(gold_cover), 9) AS mean_cover FROM grounded""")
def groundedness_summary(spark, sf_dir):
    return _grounded(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold_cover") >= 0.6).cast("double")), 9).alias("hit_rate"),
        F.round(F.avg((F.col("pred_cover") >= 0.5).cast("double")), 9).alias("grounded_rate"), F.round(F.avg("gold_cover"), 9).alias("mean_cover"),
    )


RATES = ", ".join(
    f"round(count(*) FILTER ({c} = {i}) / greatest(count({c}), 1)::DOUBLE, 9) AS {c}_{i}" for c in ("predicted_idx", "answer_idx") for i in range(4)
)
EXCESS = ", ".join(f"abs(count(*) FILTER (predicted_idx = {i}) / greatest(count(predicted_idx), 1)::DOUBLE - count(*) FILTER (answer_idx = {i}) / greatest(count(answer_idx), 1)::DOUBLE)" for i in range(4))


@query(f"WITH {P} SELECT arm, {RATES}, round(greatest({EXCESS}), 9) AS max_excess FROM preds GROUP BY arm")
def position_bias(spark, sf_dir):
    made = stats.position_bias(st.predictions(spark, sf_dir))
    return made.select("arm", *[F.round(c, 9).alias(c) for c in made.columns if c != "arm"])


PERM = f"""{st.GOLD}, keyed AS (SELECT question_id, answer_idx, i, {st.h('"perm"', "7", "question_id", "i")} AS k FROM gold, (VALUES (0), (1), (2), (3)) v(i)),
perm AS (SELECT question_id, any_value(answer_idx) AS answer_idx, list(i ORDER BY k, i) AS ord FROM keyed GROUP BY question_id)"""


@query(f"WITH {PERM} SELECT question_id, array_to_string(ord, ',') AS ord, CAST(list_position(ord, answer_idx) - 1 AS INTEGER) AS answer_idx FROM perm")
def permute_options(spark, sf_dir):
    rows = _permuted(spark, sf_dir)
    return rows.select("question_id", F.array_join("ord", ",").alias("ord"), "answer_idx")


def _permuted(spark, sf_dir):
    options = F.array(*[F.lit(x) for x in "abcd"])
    rows = st.gold(spark, sf_dir).withColumn("ord", sc.permuted(options, F.col("question_id"), 7))
    return rows.withColumn("answer_idx", (F.expr("array_position(ord, answer_idx)") - 1).cast("int"))


@query(f"""WITH {P}, moved AS (SELECT question_id, CAST({st.h('"pm"', "question_id")} % 4 AS INTEGER) AS idx FROM gold),
a AS (SELECT arm, avg(CAST(ok AS DOUBLE)) AS original, avg(CAST(CASE WHEN {st.h('"pk"', "question_id")} % 10 < 8 THEN ok ELSE idx = answer_idx END AS DOUBLE)) AS permuted FROM preds JOIN moved USING (question_id) GROUP BY arm)
SELECT arm, round(original, 9) AS original, round(permuted, 9) AS permuted, round(original - permuted, 9) AS drop_, round(CASE WHEN original <= 0 THEN 0 ELSE (original - permuted) / original END, 9) AS relative_drop,
  CASE WHEN original - permuted <= 0.03 THEN 'stable' WHEN original - permuted <= 0.09 THEN 'mild' ELSE 'strong' END AS verdict FROM a""")
def permutation_accuracy(spark, sf_dir):
    rows = _ok(spark, sf_dir)
    again = F.when(sc.draw("pk", F.col("question_id")) % 10 < 8, F.col("ok")).otherwise((sc.draw("pm", F.col("question_id")) % 4) == F.col("answer_idx"))
    rows = rows.groupBy("arm").agg(F.avg(F.col("ok").cast("double")).alias("original"), F.avg(again.cast("double")).alias("permuted"))
    drop = F.col("original") - F.col("permuted")
    relative = F.when(F.col("original") <= 0, 0.0).otherwise(drop / F.col("original"))
    return rows.select("arm", F.round("original", 9).alias("original"), F.round("permuted", 9).alias("permuted"), F.round(drop, 9).alias("drop_"), F.round(relative, 9).alias("relative_drop"), sc.drop_band(drop).alias("verdict"))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
HALVES = f"""b AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
halves AS (SELECT item_id, array_to_string(ws[1:cut], ' ') AS prefix, array_to_string(ws[cut + 1:], ' ') AS rest FROM (SELECT *, greatest(1, len(ws) // 2) AS cut FROM b)),
tok AS (SELECT item_id, {TOKENS.format("prefix")} AS p, {TOKENS.format("rest")} AS r, {TOKENS.format("coalesce(lead(rest) OVER (ORDER BY item_id), first(rest) OVER (ORDER BY item_id))")} AS c FROM halves),
scored AS (SELECT item_id, CASE WHEN len(r) = 0 THEN 0 ELSE len(list_intersect(p, r)) / len(r)::DOUBLE END AS overlap, CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(p, c)) / len(c)::DOUBLE END AS control FROM tok)"""


@query(f"WITH {HALVES} SELECT item_id, round(overlap, 9) AS overlap, round(control, 9) AS control FROM scored")
def verbatim_control(spark, sf_dir):
    rows = _verbatim(spark, sf_dir)
    return rows.select("item_id", F.round("overlap", 9).alias("overlap"), F.round("control", 9).alias("control"))


@query(f"""WITH {HALVES} SELECT count(*) AS n, round(avg(overlap), 9) AS mean_overlap, round(avg(CAST(overlap >= 0.75 AS DOUBLE)), 9) AS high_rate, round(avg(control), 9) AS mean_control,
  CASE WHEN avg(CAST(overlap >= 0.75 AS DOUBLE)) < 0.05 THEN 'low' WHEN avg(CAST(overlap >= 0.75 AS DOUBLE)) < 0.15 THEN 'moderate' ELSE 'high' END AS verdict FROM scored""")
def verbatim_overlap(spark, sf_dir):
    high = F.avg((F.col("overlap") >= 0.75).cast("double"))
    return _verbatim(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 9).alias("mean_overlap"), F.round(high, 9).alias("high_rate"),
        F.round(F.avg("control"), 9).alias("mean_control"), sc.verbatim_band(high).alias("verdict"),
    )


def _verbatim(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", tx.split_stem(F.col("text")).alias("s")).select("item_id", "s.prefix", "s.rest")
    rows = stats.cyclic_next(rows, "rest", "item_id")
    p = tx.alnum_words(F.col("prefix"))
    return rows.select("item_id", sc.overlap_share(p, tx.alnum_words(F.col("rest"))).alias("overlap"), sc.overlap_share(p, tx.alnum_words(F.col("control"))).alias("control"))


CASES = f"""{P}, ref AS (SELECT question_id, coalesce(predicted_idx = answer_idx, false) AS other FROM preds WHERE arm = 'base'),
gaps AS (SELECT p.*, other, CASE WHEN option_logs IS NULL THEN 0 ELSE list_sort(option_logs, 'DESC')[1] - list_sort(option_logs, 'DESC')[2] END AS margin FROM preds p LEFT JOIN ref USING (question_id) WHERE arm = 'rag-parity'),
cases AS (SELECT arm, question_id, subject, margin, CASE WHEN predicted_idx IS NULL THEN 'unscorable' WHEN predicted_idx = answer_idx AND NOT other THEN 'fixed_by_retrieval'
  WHEN predicted_idx <> answer_idx AND other THEN 'broken_by_retrieval' WHEN predicted_idx = answer_idx THEN 'correct' WHEN margin >= 1 THEN 'confident_wrong' WHEN margin <= 0.15 THEN 'near_miss' ELSE 'wrong' END AS category FROM gaps),
errors AS (SELECT * FROM cases WHERE category NOT IN ('correct', 'unscorable'))"""


def _errors(spark, sf_dir):
    rows = _ok(spark, sf_dir)
    return report.collect_errors(rows.filter("arm = 'rag-parity'"), rows.filter("arm = 'base'"))


@query(f"WITH {CASES} SELECT category, count(*) AS n, round(avg(margin), 9) AS mean_margin FROM errors GROUP BY category")
def error_taxonomy(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 9).alias("mean_margin"))


@query(f"""WITH {CASES} SELECT question_id, category, '' AS human_label, '' AS notes FROM errors
QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('42|' || question_id), question_id) <= 10""")
def error_review_sample(spark, sf_dir):
    made = split.sample_per(_errors(spark, sf_dir), "category", 10, key="question_id")
    return report.review_sheet(made).select("question_id", "category", "human_label", "notes")


BUCKETS = f"""{P}, w AS (SELECT question_id, bool_or(ok) FILTER (arm = 'base') AS b, bool_or(ok) FILTER (arm = 'qlora') AS t, bool_or(ok) FILTER (arm = 'rag-parity') AS r FROM preds GROUP BY question_id),
buckets AS (SELECT question_id, CASE WHEN t AND NOT r THEN 'weights_only' WHEN r AND NOT t THEN 'index_only' WHEN b AND NOT t AND NOT r THEN 'both_broke_it'
  WHEN NOT b AND t AND r THEN 'both_fixed_it' WHEN b AND t AND r THEN 'everyone_right' ELSE 'everyone_wrong' END AS bucket FROM w)"""


def _buckets(spark, sf_dir):
    rows = report.pivot(_ok(spark, sf_dir), "question_id", ["base", "qlora", "rag-parity"], "ok")
    return rows.select("question_id", sc.bucket(F.col("base"), F.col("qlora"), F.col("`rag-parity`")).alias("bucket"))


@query(f"WITH {BUCKETS} SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket")
def disagreement_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BUCKETS} SELECT * FROM buckets QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5('42|' || question_id), question_id) <= 10")
def demo_sample(spark, sf_dir):
    return split.sample_per(_buckets(spark, sf_dir), "bucket", 10, key="question_id")


@query(f"WITH {st.REPLIES} SELECT arm, seed, score, count(*) AS n FROM scores WHERE score IS NOT NULL GROUP BY arm, seed, score")
def judge_parse_score(spark, sf_dir):
    rows = st.replies(spark, sf_dir).select("arm", "seed", tx.parse_score(F.col("reply")).alias("score")).filter("score is not null")
    return rows.groupBy("arm", "seed", "score").agg(F.count(F.lit(1)).alias("n"))


VERDICTS = ("VERDICT: A", "verdict : b", "VERDICT: TIE", "Verdict: Neither A nor B", "VERDICT: both", "no verdict", "VERDICT: Answer B")
VERDICT_REPLIES = f"""{st.GOLD}, said AS (SELECT question_id, arm AS pair, list_extract([{", ".join(f"'{v}'" for v in VERDICTS)}], CAST(1 + {st.h('"v"', "arm", "question_id")} % {len(VERDICTS)} AS BIGINT)) AS forward,
  list_extract([{", ".join(f"'{v}'" for v in VERDICTS)}], CAST(1 + {st.h('"u"', "arm", "question_id")} % {len(VERDICTS)} AS BIGINT)) AS back FROM gold, (VALUES {", ".join(f"('{a}')" for a in ARMS)}) a(arm)),
parsed AS (SELECT *, upper(regexp_extract(forward, '(?i)VERDICT\\s*:\\s*(TIE|NEITHER|BOTH|A|B)\\b', 1)) AS f, upper(regexp_extract(back, '(?i)VERDICT\\s*:\\s*(TIE|NEITHER|BOTH|A|B)\\b', 1)) AS r FROM said),
verdicts AS (SELECT question_id, pair, CASE WHEN f IN ('TIE', 'NEITHER', 'BOTH') THEN 'TIE' ELSE nullif(f, '') END AS f, CASE WHEN r IN ('TIE', 'NEITHER', 'BOTH') THEN 'TIE' WHEN r = 'A' THEN 'B' WHEN r = 'B' THEN 'A' END AS r FROM parsed)"""


def _verdicts(spark, sf_dir):
    said = F.array(*map(F.lit, VERDICTS))
    rows = st.gold(spark, sf_dir).select("question_id", F.explode(F.array(*map(F.lit, ARMS))).alias("pair"))
    pick = lambda k: F.get(said, (sc.draw(k, F.col("pair"), F.col("question_id")) % len(VERDICTS)).cast("int"))
    return rows.select("question_id", "pair", pick("v").alias("forward"), pick("u").alias("reversed"))


@query(f"WITH {VERDICT_REPLIES} SELECT coalesce(f, 'none') AS verdict, count(*) AS n FROM verdicts GROUP BY 1")
def judge_parse_verdict(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select(F.coalesce(tx.parse_verdict(F.col("forward")), F.lit("none")).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VERDICT_REPLIES}, o AS (SELECT pair, CASE WHEN f IS NULL OR r IS NULL THEN 'u' WHEN f <> r THEN 'i' WHEN f = 'TIE' THEN 't' ELSE f END AS o FROM verdicts)
SELECT pair, count(*) AS n, count(*) FILTER (o = 'A') AS a_wins, count(*) FILTER (o = 'B') AS b_wins, count(*) FILTER (o = 't') AS ties, count(*) FILTER (o = 'i') AS inconsistent,
  count(*) FILTER (o = 'u') AS unparseable, round(count(*) FILTER (o = 'i') / count(*)::DOUBLE, 9) AS position_bias_rate FROM o GROUP BY pair""")
def judge_pairwise_summary(spark, sf_dir):
    return judging.pairwise_summary(_verdicts(spark, sf_dir)).withColumn("position_bias_rate", F.round("position_bias_rate", 9))


ITEMS = f"""{st.REPLIES}, counted AS (SELECT arm, question_id, score, count(*) AS c, min(seed) AS first FROM scores WHERE score IS NOT NULL GROUP BY ALL),
modes AS (SELECT arm, question_id, arg_min(score, (-c, first)) AS majority FROM counted GROUP BY ALL),
items AS (SELECT arm, question_id, count(score) AS n, coalesce(avg(score), 0) AS mean, coalesce(stddev_samp(score), 0) AS sd, count(*) - count(score) AS unparseable FROM scores GROUP BY arm, question_id)"""


@query(f"WITH {ITEMS} SELECT arm, question_id, majority, round(mean, 9) AS mean, round(sd, 9) AS sd FROM items JOIN modes USING (arm, question_id)")
def judge_item_mode(spark, sf_dir):
    rows = judging.item_grades(st.replies(spark, sf_dir)).filter("majority is not null")
    return rows.select("arm", "question_id", "majority", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query(f"WITH {ITEMS} SELECT arm, count(*) AS n, round(avg(mean / 2), 9) AS mean_score, round(avg(sd), 9) AS judge_sd, CAST(sum(unparseable) AS BIGINT) AS unparseable FROM items GROUP BY arm")
def judge_arm_summary(spark, sf_dir):
    rows = judging.arm_grades(judging.item_grades(st.replies(spark, sf_dir)))
    return rows.select("arm", "n", F.round("mean_score", 9).alias("mean_score"), F.round("judge_sd", 9).alias("judge_sd"), "unparseable")


@query(f"WITH {ITEMS} SELECT arm, question_id, round(mean / 2, 9) AS graded, CAST(majority = 2 AS INTEGER) AS strict FROM items JOIN modes USING (arm, question_id)")
def judge_strict_scores(spark, sf_dir):
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    return rows.select("arm", "question_id", F.round("graded", 9).alias("graded"), "strict")


def flips_sql(diffs: str) -> str:
    """CTEs of ``tests`` (pair, n, total, higher, lower, p): the sign-flip test of whole numbers d by pair of a table."""
    return f"""seen AS (SELECT pair, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, count(*) FILTER (d > 0) AS higher, count(*) FILTER (d < 0) AS lower FROM {diffs} GROUP BY pair),
alike AS (SELECT pair, abs(d) AS size, count(*) AS items FROM {diffs} WHERE d <> 0 GROUP BY ALL),
chunks AS (SELECT pair, size, chunk, least(60, items - 60 * chunk) AS width FROM (SELECT *, unnest(range(0, (items - 1) // 60 + 1)) AS chunk FROM alike)),
flips AS (SELECT pair, r, sum(size * (2 * bit_count(('0x' || substr(md5('flip|42|' || pair || '|' || size || '|' || chunk || '|' || r), 1, 15))::UBIGINT >> (60 - width)::UBIGINT) - width)) AS s
  FROM chunks, range(0, 20000) t(r) GROUP BY pair, r),
tests AS (SELECT pair, n, total, higher, lower, (coalesce(far, 20000) + 1) / 20001::DOUBLE AS p
FROM seen LEFT JOIN (SELECT pair, count(*) FILTER (abs(s) >= abs(total)) AS far FROM flips JOIN seen USING (pair) GROUP BY pair) USING (pair))"""


FLIPS = f"""WITH {ITEMS}, strict AS (SELECT arm, question_id, CAST(majority = 2 AS INTEGER) AS s FROM modes),
diffs AS (SELECT x.arm AS pair, x.s - y.s AS d FROM strict x JOIN strict y ON x.question_id = y.question_id AND y.arm = 'base' WHERE x.arm <> 'base'), {flips_sql("diffs")}
SELECT pair, n, total, higher, lower, round(p, 9) AS p FROM tests"""


@query(FLIPS)
def signflip_test(spark, sf_dir):
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    base = rows.filter("arm = 'base'").select("question_id", F.col("strict").alias("b"))
    diffs = rows.filter("arm != 'base'").join(base, "question_id").select(F.col("arm").alias("pair"), F.col("question_id").alias("id"), (F.col("strict") - F.col("b")).alias("d"))
    return stats.sign_flips(diffs, rounds=20_000).withColumn("p", F.round("p", 9))


#: Pairs of arms of which graded scores are compared.
GRADED_PAIRS = [("qlora", "base"), ("rag-parity", "base"), ("qlora-rag-parity", "rag-parity")]


@query(f"""WITH {ITEMS}, told AS (SELECT arm, question_id, mean / 2 AS value FROM items WHERE n > 0), asked(arm_a, arm_b) AS (VALUES {", ".join(map(str, GRADED_PAIRS))}),
differ AS (SELECT arm_a || ' - ' || arm_b AS pair, arm_a, arm_b, x.value - y.value AS value FROM asked JOIN told x ON x.arm = arm_a JOIN told y ON y.arm = arm_b AND y.question_id = x.question_id),
whole AS (SELECT pair, CAST(round(value * 12) AS BIGINT) AS d FROM differ), {boot_sql("differ", "pair")}, {flips_sql("whole")}
SELECT pair, arm_a, arm_b, n, round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, round(p, 9) AS p, higher, lower
FROM (SELECT pair, any_value(arm_a) AS arm_a, any_value(arm_b) AS arm_b, avg(value) AS delta FROM differ GROUP BY pair) JOIN ends ON g = pair JOIN tests USING (pair)""")
def paired_intervals(spark, sf_dir):
    """Differences of mean grades between arms, on the items that both have: twelfths, as grades are thirds of at most two."""
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    made = stats.paired_intervals(stats.paired_differences(rows, GRADED_PAIRS, value="graded"), scale=12)
    return made.select("pair", "arm_a", "arm_b", "n", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high", "p")], "higher", "lower")


HUMAN = f"CASE WHEN {st.h('\"h\"', 'question_id')} % 4 = 0 THEN (majority + 1) % 3 ELSE majority END"


@query(f"""WITH {ITEMS}, g AS (SELECT {HUMAN} AS human, majority AS machine FROM modes WHERE arm = 'base'),
c AS (SELECT count(*)::DOUBLE AS n, avg(CAST(human = machine AS DOUBLE)) AS po FROM g),
e AS (SELECT sum(x.c * y.c) / max(n * n) AS pe FROM (SELECT human, count(*) AS c FROM g GROUP BY 1) x JOIN (SELECT machine, count(*) AS c FROM g GROUP BY 1) y ON human = machine, c)
SELECT CAST(n AS BIGINT) AS n, round(po, 9) AS exact, round((po - pe) / (1 - pe), 9) AS kappa,
  CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'worse than chance' WHEN (po - pe) / (1 - pe) < 0.21 THEN 'slight' WHEN (po - pe) / (1 - pe) < 0.41 THEN 'fair' WHEN (po - pe) / (1 - pe) < 0.61 THEN 'moderate' WHEN (po - pe) / (1 - pe) < 0.81 THEN 'substantial' ELSE 'almost perfect' END AS verdict FROM c, e""")
def judge_kappa(spark, sf_dir):
    rows = judging.item_grades(st.replies(spark, sf_dir)).filter("arm = 'base' and majority is not null")
    human = F.when(sc.draw("h", F.col("question_id")) % 4 == 0, (F.col("majority") + 1) % 3).otherwise(F.col("majority"))
    made = stats.kappa(rows.select(human.alias("human"), F.col("majority").alias("machine")))
    return made.select("n", F.round("exact", 9).alias("exact"), F.round("kappa", 9).alias("kappa"), sc.kappa_band(F.col("kappa")).alias("verdict"))


@query(f"""WITH {ITEMS}, m AS (SELECT question_id AS id, majority AS grade, row_number() OVER (PARTITION BY majority ORDER BY question_id) AS place FROM modes WHERE arm = 'base'),
t AS (SELECT *, CASE WHEN place <= greatest(1, 50 // (SELECT count(DISTINCT grade) FROM m)) THEN 0 ELSE 1 END AS turn FROM m)
SELECT id, grade FROM t QUALIFY turn = 0 OR row_number() OVER (ORDER BY turn, grade, id) <= 50""")
def kappa_sheet_sample(spark, sf_dir):
    rows = judging.item_grades(st.replies(spark, sf_dir)).filter("arm = 'base' and majority is not null")
    return split.sheet_sample(rows.select(F.col("question_id").alias("id"), F.col("majority").alias("grade")), 50)


CURVE = f"""{st.COSTS_SQL}, curve AS (SELECT arm, volume, fixed_s * {st.GPU_HOUR}::DOUBLE / 3600 / volume + query_s * {st.GPU_HOUR}::DOUBLE / 3600 AS usd
  FROM costs, (VALUES {", ".join(f"({v})" for v in st.VOLUMES)}) v(volume))"""


@query(f"WITH {CURVE} SELECT arm, CAST(volume AS BIGINT) AS volume, round(usd, 9) AS usd_per_query, round(usd * 1000, 6) AS usd_per_1k FROM curve")
def cost_curve(spark, sf_dir):
    rows = report.cost_curve(st.cost_rows(spark, sf_dir), st.VOLUMES, per_hour=st.GPU_HOUR)
    return rows.select("arm", "volume", F.round("usd_per_query", 9).alias("usd_per_query"), F.round("usd_per_1k", 6).alias("usd_per_1k"))


@query(f"""WITH {CURVE} SELECT CAST(volume AS BIGINT) AS volume, {", ".join(f"round(max(usd * 1000) FILTER (arm = '{a}'), 6) AS " + a.replace("-", "_") for a in ARMS)} FROM curve GROUP BY volume""")
def cost_pivot(spark, sf_dir):
    rows = report.cost_curve(st.cost_rows(spark, sf_dir), st.VOLUMES, per_hour=st.GPU_HOUR)
    rows = report.pivot(rows, "volume", ARMS, "usd_per_1k")
    return rows.select("volume", *[F.round(F.col(f"`{a}`"), 6).alias(a.replace("-", "_")) for a in ARMS])


@query(f"""WITH {st.COSTS_SQL}, x AS (SELECT a.arm AS arm_a, b.arm AS arm_b, (a.fixed_s - b.fixed_s)::DOUBLE / nullif((b.query_s - a.query_s)::DOUBLE, 0) AS v FROM costs a JOIN costs b ON a.arm < b.arm)
SELECT arm_a, arm_b, CAST(round_even(v, 0) AS BIGINT) AS volume FROM x WHERE v > 0 AND round_even(v, 0) BETWEEN 100 AND 10000000""")
def cost_crossover(spark, sf_dir):
    return report.crossovers(st.cost_rows(spark, sf_dir), per_hour=st.GPU_HOUR, low=st.VOLUMES[0], high=st.VOLUMES[-1])


@query(f"WITH {CURVE} SELECT CAST(volume AS BIGINT) AS volume, arg_min(arm, usd) AS arm FROM curve GROUP BY volume")
def cost_cheapest(spark, sf_dir):
    return report.cheapest(report.cost_curve(st.cost_rows(spark, sf_dir), st.VOLUMES, per_hour=st.GPU_HOUR), list(ARMS))


@query("""WITH a AS (SELECT source AS arm, CASE WHEN n_chars % 7 = 0 THEN '  ' ELSE text END AS answer, n_chars % 300 AS tokens FROM documents)
SELECT arm, count(*) AS n, count(*) FILTER (trim(answer) = '') AS empty_answers, count(*) FILTER (tokens >= 256) AS capped_answers, round(avg(tokens), 9) AS mean_completion_tokens FROM a GROUP BY arm""")
def empty_capped(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("arm"), F.when(F.col("n_chars") % 7 == 0, "  ").otherwise(F.col("text")).alias("answer"), (F.col("n_chars") % 300).alias("completion_tokens"))
    return report.answer_accounting(rows, bound=256).withColumn("mean_completion_tokens", F.round("mean_completion_tokens", 9))


@query("""SELECT o_orderpriority AS grp, count(*) AS n_jobs, round(sum(o_totalprice), 2) AS hours, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1""")
def job_hours_by_group(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    jobs = o.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("hours"), status.alias("status"))
    made = report.hours_by_group(jobs)
    return made.select("grp", "n_jobs", F.round("hours", 2).alias("hours"), "done")


@query(f"WITH {RUNS} SELECT count(*) AS n_runs, count(DISTINCT arm) AS n_arms, round(max(2.801585218 * sqrt(0.5 / n)), 6) AS detectable FROM runs, (SELECT count(*) AS n FROM gold)")
def run_overview(spark, sf_dir):
    n = st.gold(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    rows = _runs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("arm").alias("n_arms"))
    return rows.crossJoin(n).select("n_runs", "n_arms", F.round(sc.detectable_effect(F.col("n")), 6).alias("detectable"))
