"""Queries on records that travel through files, on items, prompts, stores and checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import scores as sc
from ..functions import text as tx
from ..operators import clean, hooks, judging, report, retrieval, split, stats
from ..operators.selection import percentiles
from ..sources import commits, files, scratch
from ..sources.scratch import store
from ..sources.tables import read_table
from . import standins as st
from .corpus import CLEANED, DROPPED_PAIRS, HOLDOUT, OPTION_SQL, OVERRIDE_ROWS, _cleaned, _mined, chunks_sql, key_sql, proposals_sql, strip_sql
from .evaluation import ALL, ARMS, ITEMS, RUNS, VERDICT_REPLIES, P, _ok, _runs, _verdicts, boot_sql, flips_sql
from .registry import query

#: Questions in one file of a run: those of so many numbers in a row.
RANGE = 10_000


def _path(spark, name):
    return scratch.new_path(spark, name)


@query(f"WITH {st.QUESTIONS} SELECT id, {strip_sql('[opa, opb, opc, opd][cop + 1]')} AS reference FROM questions WHERE cop <> -1")
def reference_answers(spark, sf_dir):
    rows = st.questions(spark, sf_dir).filter("cop != -1")
    return rows.select("id", pr.reference_answer(F.array(*clean.OPTIONS), F.col("cop")).alias("reference"))


@query(f"""WITH {st.PAIRS} SELECT id, {strip_sql("question")} AS question, {strip_sql("answer")} AS gold, '{pr.PLACEHOLDER}' AS other, 'Unknown' AS subject, CAST(passage AS VARCHAR) AS explanation FROM pairs""")
def pair_questions(spark, sf_dir):
    rows = st.pairs_by_passage(spark, sf_dir)
    made = pr.pair_as_question(F.col("question"), F.col("answer"), F.col("passage").cast("string"), F.lit(""))
    rows = rows.select("id", *[c.alias(k) for k, c in made.items()])
    return rows.select("id", "question", F.get("options", F.col("answer_idx")).alias("gold"), F.get("options", F.lit(1)).alias("other"), "subject", "explanation")


@query(f"""WITH {st.QUESTIONS}, golds AS (SELECT id, [opa, opb, opc, opd][cop + 1] AS gold FROM questions WHERE cop <> -1)
SELECT id, gold FROM golds WHERE CASE {OPTION_SQL} END IS NULL ORDER BY md5('42|' || id), id LIMIT 100""")
def freetext_sample(spark, sf_dir):
    gold = F.when(F.col("cop") >= 0, F.get(F.array(*clean.OPTIONS), "cop"))
    return split.freetext_items(st.questions(spark, sf_dir).select("id", gold.alias("gold")), 100)


TARGETS = f"""{CLEANED}, kept AS (SELECT id, question, cop, exp FROM cleaned WHERE status = 'kept'), reasons AS ({key_sql("id, question, cop", "exp", "kept")}),
targets AS (SELECT id, question, ['A', 'B', 'C', 'D'][cop + 1] || CASE WHEN stripped <> '' THEN chr(10) || chr(10) || stripped ELSE '' END AS target, stripped FROM reasons)"""


def _targets(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).filter("status = 'kept'")
    reason = tx.strip_answer_key(F.coalesce("explanation", F.lit("")))
    return rows.select("id", "question", "options", "answer_idx", reason.alias("reason"))


@query(f"WITH {TARGETS} SELECT id, target, 3 AS n_messages, length(target) AS n_chars FROM targets")
def sft_targets(spark, sf_dir):
    rows = _targets(spark, sf_dir)
    target = pr.training_target(F.col("answer_idx"), F.col("reason"))
    rows = rows.select("id", pr.chat_messages(pr.mcq_prompt(F.col("question"), F.col("options")), target).alias("messages"))
    last = F.get("messages", F.lit(2))["content"]
    return rows.select("id", last.alias("target"), F.size("messages").alias("n_messages"), F.length(last).cast("long").alias("n_chars"))


@query(f"""WITH {TARGETS} SELECT (SELECT count(*) FROM cleaned) AS seen, count(*) AS kept, (SELECT count(*) FROM cleaned WHERE status = 'unlabelled') AS dropped_unlabelled,
count(*) FILTER (stripped <> '') AS with_explanation, CAST(coalesce(sum(length(target)), 0) AS BIGINT) AS target_chars, round(coalesce(sum(length(target)) / count(*)::DOUBLE, 0), 6) AS mean_target_chars FROM targets""")
def sft_stats(spark, sf_dir):
    rows = _cleaned(spark, sf_dir)
    reason = F.when(F.col("status") == "kept", tx.strip_answer_key(F.coalesce("explanation", F.lit(""))))
    rows = rows.select("status", reason.alias("reason"), F.length(pr.training_target(F.col("answer_idx"), reason)).alias("n"))
    kept = F.col("status") == "kept"
    made = rows.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"), F.count_if(F.col("status") == "unlabelled").alias("dropped_unlabelled"),
        F.count_if(kept & (F.col("reason") != "")).alias("with_explanation"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("target_chars"),
    )
    return made.withColumn("mean_target_chars", F.round(sc.share(F.col("target_chars"), F.col("kept")), 6))


@query(f"WITH {HOLDOUT} SELECT split, count(*) AS n, count(DISTINCT passage) AS passages FROM parted GROUP BY split")
def holdout_stats(spark, sf_dir):
    rows = split.grouped_holdout(st.pairs_by_passage(spark, sf_dir), n_train=400, n_test=50)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("passage").alias("passages"))


@query(f"""WITH RECURSIVE {HOLDOUT}, passages AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
  WHERE conv_id IN (SELECT passage FROM parted WHERE split = 'train') GROUP BY conv_id), {chunks_sql("passages")} SELECT doc_id, pos, chunk FROM chunked""")
def doc_records(spark, sf_dir):
    parted = split.grouped_holdout(st.pairs_by_passage(spark, sf_dir), n_train=400, n_test=50)
    trained = parted.filter("split = 'train'").select(F.col("passage").alias("conv_id")).distinct()
    rows = read_table(spark, sf_dir, "conversations").join(trained, "conv_id", "left_semi").groupBy("conv_id")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    text = F.array_join(F.transform("said", lambda m: m["text"]), " ")
    return retrieval.chunk_rows(rows.select(F.col("conv_id").alias("doc_id"), text.alias("text")))


@query("SELECT doc_id, sha1(text) AS key FROM documents")
def passage_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.passage_key(F.col("text")).alias("key"))


def _rubric_sql(rubric: str, **parts: str) -> str:
    out = "'" + rubric.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in parts.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


CANDIDATE_SQL = f"CASE WHEN {st.h('\"blank\"', 'id')} % 5 = 0 THEN '{pr.NO_ANSWER}' ELSE opb END"


@query(f"""WITH {st.QUESTIONS}, q AS (SELECT id, {strip_sql("question")} AS question, {strip_sql("opa")} AS opa, coalesce(nullif({strip_sql("opb")}, ''), '{pr.NO_ANSWER}') AS opb FROM questions)
SELECT id, '{pr.RUBRIC_VERSION}' AS rubric_version, sha256({_rubric_sql(pr.POINTWISE, question="question", reference="opa", candidate=CANDIDATE_SQL)}) AS pointwise,
  sha256({_rubric_sql(pr.PAIRWISE, question="question", reference="opa", answer_a=CANDIDATE_SQL, answer_b="opb")}) AS pairwise FROM q""")
def judge_prompts(spark, sf_dir):
    blank = F.when(sc.draw("blank", F.col("id")) % 5 == 0, " \n").otherwise(F.col("opb"))
    rows = st.questions(spark, sf_dir).select("id", "question", "opa", "opb", blank.alias("said"))
    told = {"question": F.col("question"), "reference": F.col("opa")}
    one = pr.judge_prompt(pr.POINTWISE, **told, candidate=F.col("said"))
    two = pr.judge_prompt(pr.PAIRWISE, **told, answer_a=F.col("said"), answer_b=F.col("opb"))
    return rows.select("id", F.lit(pr.RUBRIC_VERSION).alias("rubric_version"), F.sha2(one, 256).alias("pointwise"), F.sha2(two, 256).alias("pairwise"))


@query(f"WITH {P} SELECT arm, round(avg(CAST(ok AS DOUBLE)) * 100, 1) AS accuracy, 1.5::DOUBLE AS low, 98.5::DOUBLE AS high FROM preds GROUP BY arm")
def card_results(spark, sf_dir):
    rows = _ok(spark, sf_dir).groupBy("arm").agg(F.avg(F.col("ok").cast("double")).alias("a"))
    line = F.concat(F.lit("| `"), F.col("arm"), F.lit("` | "), F.round(F.col("a") * 100, 1).cast("string"), F.lit(" % [1.5, 98.5] | x |"))
    card = rows.agg(F.array_join(F.concat(F.array(F.lit("# Card\n\n| Arm | Accuracy |\n| --- | --- |")), F.collect_list(line)), "\n").alias("card"))
    return card.select(F.explode(tx.card_results(F.col("card"))).alias("arm", "r")).select("arm", "r.accuracy", "r.low", "r.high")


@query(f"""WITH {ALL} SELECT arm, seed, arm || '_seed' || seed AS file, count(*) AS n_items, round(avg(CAST(ok AS DOUBLE)), 9) AS accuracy, true AS exclusive,
  round(avg(100 + question_id % 50), 9) AS mean_prompt_tokens FROM preds GROUP BY arm, seed""")
def run_files(spark, sf_dir):
    """Run files, written and read again: a document per arm, seed and range of questions, so that none grows with the run."""
    rows = _ok(spark, sf_dir, st.SEEDS).withColumn("part", F.expr(f"question_id div {RANGE}"))
    told = F.struct(F.col("question_id").cast("string").alias("question_id"), "predicted_idx", F.col("option_logs").alias("option_logprobs"), (100 + F.col("question_id") % 50).cast("int").alias("prompt_tokens"))
    runs = rows.groupBy("arm", "seed", "part").agg(F.count(F.lit(1)).cast("int").alias("n_items"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.collect_list(told).alias("predictions"))
    name = F.concat_ws(".", tx.run_stem(F.col("arm"), F.col("seed")), F.col("part").cast("string"))
    files.write_documents(runs.withColumn("name", name).drop("part"), path := _path(spark, "runs"))
    runs = files.read_runs(spark, path)
    tokens = files.run_predictions(runs).groupBy("arm", "seed").agg(F.round(F.coalesce(F.avg("prompt_tokens"), F.lit(0.0)), 9).alias("mean_prompt_tokens"))
    n = F.sum("n_items")
    runs = runs.groupBy("arm", "seed", F.substring_index("file", ".", 1).alias("file")).agg(
        n.cast("long").alias("n_items"), F.round(F.sum(F.col("accuracy") * F.col("n_items")) / n, 9).alias("accuracy"), F.bool_and("exclusive").alias("exclusive")
    )
    return runs.join(tokens, ["arm", "seed"])


def _judged(spark, sf_dir, strict):
    items = judging.item_grades(st.replies(spark, sf_dir)).withColumn("part", F.expr(f"question_id div {RANGE}"))
    scores = F.when(F.col("majority").isNotNull(), F.array("majority"))
    told = F.struct(F.col("question_id").cast("string").alias("item_id"), scores.alias("scores"), "majority", "mean")
    rows = items.groupBy("arm", "part").agg(F.avg("sd").alias("judge_sd"), F.collect_list(told).alias("items"))
    files.write_documents(rows.withColumn("name", F.concat_ws(".", "arm", F.col("part").cast("string"))).drop("part"), path := _path(spark, "judged"))
    return files.read_judged(spark, path, strict=strict)


@query(f"WITH {ITEMS} SELECT arm, CAST(question_id AS VARCHAR) AS item_id, round(mean / 2, 9) AS score FROM items JOIN modes USING (arm, question_id)")
def judged_files(spark, sf_dir):
    return _judged(spark, sf_dir, False).withColumn("score", F.round("score", 9))


@query(f"WITH {ITEMS} SELECT arm, CAST(question_id AS VARCHAR) AS item_id, CASE WHEN majority = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM items JOIN modes USING (arm, question_id)")
def judged_files_strict(spark, sf_dir):
    return _judged(spark, sf_dir, True)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, 'documents' AS corpus, NULL::VARCHAR AS source_question_id, source AS title FROM documents")
def passage_file(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("documents").alias("corpus"), F.lit(None).cast("string").alias("source_question_id"), F.col("source").alias("title"))
    files.write_json_lines(rows, path := _path(spark, "passages"))
    return files.read_passages(spark, path, rows.count())


@query(f"""WITH {st.GOLD} SELECT CAST(question_id AS VARCHAR) AS question_id, CAST({st.h('"hs"', "question_id")} % 3 AS INTEGER) AS human_score FROM gold
WHERE {st.h('"hs"', "question_id")} % 4 <> 0 AND question_id % 2 = 0""")
def human_sheet(spark, sf_dir):
    """A sheet written, filled in part, and read against the items that were asked."""
    rows = st.gold(spark, sf_dir).select("question_id", F.lit('a, "b"').alias("question"), F.lit("r").alias("reference"), F.lit("").alias("candidate"))
    files.write_sheet(rows, path := _path(spark, "sheet"), ("human_score", "notes"))
    drawn = sc.draw("hs", F.col("question_id"))
    sheet = spark.read.option("header", True).csv(path)
    filled = sheet.withColumn("human_score", F.when(drawn % 4 != 0, (drawn % 3).cast("string")).otherwise(" "))
    filled.write.option("header", True).csv(again := _path(spark, "filled"))
    return files.read_sheet(spark, again, rows.filter("question_id % 2 = 0"))


@query(f"""WITH {proposals_sql(3, DROPPED_PAIRS)}, fixed(token, repair) AS (VALUES {OVERRIDE_ROWS})
SELECT p.token, p.repair FROM proposals p LEFT JOIN fixed f ON f.token = p.token WHERE f.token IS NULL UNION ALL SELECT token, repair FROM fixed""")
def lexicon_file(spark, sf_dir):
    files.write_lexicon(clean.build_lexicon(*_mined(spark, sf_dir), pairs=DROPPED_PAIRS), path := _path(spark, "lexicon"))
    return spark.createDataFrame(sorted(files.read_lexicon(spark, path).items()), "token string, repair string")


@query("""SELECT doc_id AS id, (length(text) % 97)::FLOAT AS a, ((length(text) - length(replace(text, 'e', ''))) % 97)::FLOAT AS b FROM documents""")
def vector_store(spark, sf_dir):
    """A store that a first run fills with the even documents, and a second completes."""
    encoder = lambda: lambda texts: [[len(t) % 97, t.count("e") % 97] for t in texts]
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hooks.store_vectors(texts.filter("id % 2 = 0"), encoder, path := _path(spark, "vectors"))
    rows = hooks.store_vectors(texts, encoder, path)
    return rows.select("id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))


def _busy_judge(busy: bool):
    """A maker of judges whose grade is by the MD5 of prompt and seed; a busy one fails at every fifth."""

    def judge(prompt: str, seed: int) -> str:
        drawn = int(hashlib.md5(f"judge|{prompt}|{seed}".encode()).hexdigest()[:8], 16)
        if busy and drawn % 5 == 0:
            raise OSError("busy")
        return f"SCORE: {drawn % 3}"

    return lambda: judge


JUDGED_DRAW = st.h('"judge"', "'Grade ' || question_id", "seed")


@query(f"""WITH {st.GOLD}, asked AS (SELECT question_id AS item_id, CAST(seed AS INTEGER) AS seed, {JUDGED_DRAW} AS d FROM gold, (VALUES (0), (1), (2)) s(seed))
SELECT item_id, seed, 'SCORE: ' || (d % 3) AS reply, CASE WHEN d % 5 = 0 THEN 2 ELSE 1 END AS calls FROM asked""")
def durable_judging(spark, sf_dir):
    """A busy server fails at a part of the calls; the next run asks for these alone."""
    prompt = F.concat(F.lit("Grade "), F.col("question_id").cast("string"))
    prompts = st.gold(spark, sf_dir).select(F.col("question_id").alias("item_id"), prompt.alias("prompt"))
    hooks.judge_durably(prompts, _busy_judge(True), log := _path(spark, "replies"), rubric="1", retries=0)
    return hooks.judge_durably(prompts, _busy_judge(False), log, rubric="1", workers=4)


@query(f"""WITH {st.GOLD}, s AS (SELECT subject, count(*) AS n FROM gold GROUP BY subject) SELECT split, sum(rows)::BIGINT AS rows, true AS whole FROM (
  SELECT unnest(['test', 'val', 'reserve']) AS split, unnest([100, 50, (SELECT count(*) FROM gold) - 150]) AS rows) GROUP BY split""")
def split_sink(spark, sf_dir):
    """A split written with a manifest, verified and read again."""
    rows = split.stratified_split(st.gold(spark, sf_dir), stratum="subject", test=100, val=50, key="question_id")
    commits.commit(rows, path := _path(spark, "split"), form="json", facts={"seed": 42, "test": 100, "val": 50})
    n = commits.manifest(spark, path)["rows"]
    made = commits.read(spark, path)
    return made.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.lit(n == rows.count()).alias("whole"))


@query(f"WITH {ALL} SELECT arm, seed, question_id, predicted_idx, ok FROM preds")
def run_sink(spark, sf_dir):
    """All runs' predictions in one committed table, files by run and range of questions: none holds a whole arm."""
    rows = _ok(spark, sf_dir, st.SEEDS).select("arm", "seed", "question_id", "predicted_idx", "ok")
    commits.commit(rows.repartitionByRange("arm", "seed", "question_id"), path := _path(spark, "runs"), facts={"runs": len(ARMS) * len(st.SEEDS)})
    return commits.read(spark, path)


@query(f"""WITH {P}, m AS (SELECT arm, CASE WHEN predicted_idx IS NULL THEN 'unscorable' WHEN ok THEN 'correct' ELSE 'wrong' END AS outcome FROM preds)
SELECT arm, outcome, count(*) AS n FROM m GROUP BY ALL""")
def summary_sink(spark, sf_dir):
    """Counts of outcomes by arm, written as JSON with a manifest and read again."""
    outcome = F.when(F.col("predicted_idx").isNull(), "unscorable").when(F.col("ok"), "correct").otherwise("wrong")
    counts = _ok(spark, sf_dir).groupBy("arm", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    commits.commit(counts, path := _path(spark, "summary"), form="json")
    return commits.read(spark, path)


@query(f"""WITH RECURSIVE {HOLDOUT}, passages AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
  WHERE conv_id IN (SELECT passage FROM parted WHERE split = 'train') GROUP BY conv_id), {chunks_sql("passages")}
SELECT 'qa' AS name, count(*) AS rows FROM parted WHERE split = 'train' UNION ALL SELECT 'test', count(*) FROM parted WHERE split = 'test' UNION ALL SELECT 'doc', count(*) FROM chunked""")
def parity_sink(spark, sf_dir):
    """The files of a parity corpus: question-answer records, test items and chunks, each committed and counted again."""
    parted = store(split.grouped_holdout(st.pairs_by_passage(spark, sf_dir), n_train=400, n_test=50), "parted")
    pairs = st.pairs_by_passage(spark, sf_dir).select("id", "question", "answer").join(parted.select("id", "split"), "id")
    said = pr.chat_messages(F.col("question"), F.col("answer"))
    sets = {
        "qa": pairs.filter("split = 'train'").select("id", said.alias("messages")), "test": pairs.filter("split = 'test'").select("id", "question", "answer"),
        "doc": doc_records(spark, sf_dir).select("doc_id", "pos", F.col("chunk").alias("text")),
    }
    folder, out = _path(spark, "parity"), None
    for name, rows in sets.items():
        commits.commit(rows, f"{folder}/{name}", form="json", facts={"corpus": "parity", "kind": name})
        told = commits.read(spark, f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = told if out is None else out.unionByName(told)
    return out


@query(f"""WITH {HOLDOUT}, lines AS (SELECT id, '{{"id":"' || id || '"}}' AS line FROM parted WHERE split = 'test')
SELECT id, (SELECT sha256(string_agg(line || chr(10), '' ORDER BY line)) FROM lines) AS split_sha256 FROM lines""")
def frozen_items(spark, sf_dir):
    rows = split.grouped_holdout(st.pairs_by_passage(spark, sf_dir), n_train=400, n_test=50).filter("split = 'test'")
    files.write_frozen(rows.select(F.to_json(F.struct("id")).alias("value")), path := _path(spark, "frozen"))
    items, digest = files.read_frozen(spark, path, "id string")
    return items.select("id", F.lit(digest).alias("split_sha256"))


@query(f"WITH d AS (SELECT doc_id AS id, {st.h('\"ev\"', 'doc_id')} % 10 = 0 AS held FROM documents) SELECT count(*) AS sources FROM d WHERE NOT held")
def heldout_gate(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (sc.draw("ev", F.col("doc_id")) % 10 == 0).alias("held"))
    return split.refuse_held_out(rows.filter("not held"), rows.filter("held")).agg(F.count(F.lit(1)).alias("sources"))


@query(f"WITH {st.COSTS_SQL} SELECT arm, round(fixed_s, 9) AS fixed_s, round(query_s, 9) AS query_s FROM costs")
def cost_files(spark, sf_dir):
    """Costs of arms from the files of the indices' and the training's summaries, written and read again."""
    built = st.corpora(spark, sf_dir).withColumn("name", F.col("corpus"))
    files.write_documents(built, indices := _path(spark, "indices"))
    files.write_documents(st.training(spark, sf_dir).withColumn("name", F.lit("training")), training := _path(spark, "training"))
    read = lambda path, schema: spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    speed = percentiles(st.latencies(spark, sf_dir), {"p50_s": 0.5}, by="arm", value="seconds").drop("n")
    made = report.fixed_costs(st.arm_rows(spark).join(F.broadcast(speed), "arm"), read(indices, "corpus string, embed_gpu_seconds double"), read(training, "train_gpu_seconds double"))
    return made.select("arm", F.round("fixed_s", 9).alias("fixed_s"), F.round("query_s", 9).alias("query_s"))


ACCURACY = "acc AS (SELECT arm, avg(CAST(ok AS DOUBLE)) AS accuracy FROM preds GROUP BY arm)"
GRADED = f"""{ITEMS}, graded AS (SELECT arm, count(*) AS n, avg(mean / 2) AS graded, avg(sd) AS judge_sd, count(*) FILTER (question_id % 9 = 0) AS capped FROM items GROUP BY arm)"""


def _accuracy(spark, sf_dir):
    return _ok(spark, sf_dir).groupBy("arm").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


TOLD_P = "CASE WHEN p < 0.0001 THEN replace(printf('%.0e', p), 'e-0', 'e-') WHEN p < 0.001 THEN printf('%.4f', p) ELSE printf('%.3f', p) END"


@query(f"""WITH {GRADED}, known AS (WITH {P}, {ACCURACY} SELECT * FROM acc WHERE arm <> 'qlora'), value_of AS (SELECT arm, mean / 2 AS value FROM items), {boot_sql("value_of", "arm")}
SELECT place, g.arm, b || printf('%.3f', graded) || b AS score, printf('[%.2f, %.2f]', low, high) AS interval, printf('%.3f', judge_sd) AS judge_sd,
  CASE WHEN g.arm = 'base' THEN '—' ELSE printf('%.0f', 100 * capped / n::DOUBLE) || '% @256' END AS capped, coalesce(printf('%.1f', accuracy * 100) || '%', '—') AS accuracy
FROM (SELECT *, CASE WHEN place = 1 THEN '**' ELSE '' END AS b FROM (SELECT *, row_number() OVER (ORDER BY graded DESC, arm) AS place FROM graded)) g JOIN ends ON g.arm = ends.g LEFT JOIN known ON known.arm = g.arm""")
def freetext_report(spark, sf_dir):
    items = judging.item_grades(st.replies(spark, sf_dir))
    capped = F.when(F.col("arm") != "base", F.count_if(F.col("question_id") % 9 == 0))
    arms = items.groupBy("arm").agg(F.avg(F.col("mean") / 2).alias("graded"), F.avg("sd").alias("judge_sd"), capped.alias("capped"), F.count(F.lit(1)).alias("n"))
    ends = stats.bootstrap(items.select("arm", F.col("question_id").alias("id"), (F.col("mean") / 2).alias("value")), resamples=10_000).select("arm", "low", "high")
    return report.freetext_rows(arms, ends, _accuracy(spark, sf_dir).filter("arm != 'qlora'"), bound=256)


DELTAS = f"""WITH {ITEMS}, s AS (SELECT arm, question_id, CAST(majority = 2 AS INTEGER) AS strict FROM modes), b AS (SELECT question_id, strict AS base FROM s WHERE arm = 'base'),
differ AS (SELECT arm AS pair, strict - base AS d, (strict - base)::DOUBLE AS value FROM s JOIN b USING (question_id) WHERE arm <> 'base'),
named AS (SELECT pair || ' - base' AS pair, d, value FROM differ), {boot_sql("named", "pair")}, {flips_sql("named")},
w AS (WITH {VERDICT_REPLIES}, o AS (SELECT pair, CASE WHEN f IS NULL OR r IS NULL THEN 'u' WHEN f <> r THEN 'i' WHEN f = 'TIE' THEN 't' ELSE f END AS o FROM verdicts)
  SELECT pair AS arm_a, count(*) FILTER (o = 'A') AS a_wins, count(*) FILTER (o = 'B') AS b_wins, count(*) FILTER (o = 'i') / count(*)::DOUBLE AS bias FROM o WHERE pair <> 'qlora' GROUP BY pair),
acc AS (WITH {P} SELECT arm, avg(CAST(ok AS DOUBLE)) AS accuracy FROM preds WHERE arm <> 'rag-parity' GROUP BY arm),
d AS (SELECT replace(pair, ' - base', '') AS arm_a, 'base' AS arm_b, n, total / n::DOUBLE AS delta, low, high, p, CASE WHEN p < 0.05 THEN '**' ELSE '' END AS b FROM tests JOIN ends ON g = pair)
SELECT row_number() OVER (ORDER BY delta DESC, arm_a) AS place, arm_a, arm_b, n, b || printf('%+.1f', 100 * delta) || b AS delta, printf('[%+.1f, %+.1f]', 100 * low, 100 * high) AS interval, {TOLD_P} AS p,
  coalesce(printf('%+.1f', 100 * (x.accuracy - y.accuracy)), '—') AS accuracy_delta, coalesce(a_wins || '-' || b_wins || ' (' || printf('%.0f', 100 * bias) || '% flipped)', '—') AS pairwise
FROM d LEFT JOIN w USING (arm_a) LEFT JOIN acc x ON x.arm = arm_a LEFT JOIN acc y ON y.arm = arm_b"""


@query(DELTAS)
def freetext_delta_report(spark, sf_dir):
    rows = judging.strict_grades(judging.item_grades(st.replies(spark, sf_dir)))
    pairs = [(a, "base") for a in ARMS if a != "base"]
    deltas = stats.paired_intervals(stats.paired_differences(rows, pairs, value="strict"))
    wins = judging.pairwise_summary(_verdicts(spark, sf_dir)).filter("pair != 'qlora'")
    wins = wins.select(F.col("pair").alias("arm_a"), F.lit("base").alias("arm_b"), "a_wins", "b_wins", "position_bias_rate")
    return report.delta_rows(deltas, wins, _accuracy(spark, sf_dir).filter("arm != 'rag-parity'"))


@query(f"""WITH {RUNS} SELECT arm, seed, round(accuracy, 9) AS accuracy, CASE arm {" ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ARMS[:4], 1))} ELSE 5 END AS place FROM runs WHERE arm IN ('base', 'rag-parity', 'qlora')""")
def arms_in_order(spark, sf_dir):
    rows = report.known_arms(_runs(spark, sf_dir), ["base", "rag-parity", "qlora"], ARMS)
    return rows.select("arm", "seed", F.round("accuracy", 9).alias("accuracy"), report.experiment_order(F.col("arm"), ARMS[:4]).cast("int").alias("place"))


@query("""WITH j AS (SELECT CAST(CASE WHEN o_orderkey % 500 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR) AS name, o_orderkey AS pos, o_orderpriority AS grp FROM orders),
deps AS (SELECT name, CAST(pos - CASE WHEN pos % 7 = 0 THEN -3 ELSE 4 END AS VARCHAR) AS dep FROM j WHERE pos % 20 = 3 OR pos % 70 = 0),
twice AS (SELECT name, NULL AS dep, 'repeated' AS problem FROM j GROUP BY name HAVING count(*) > 1),
met AS (SELECT d.name, d.dep, CASE WHEN o.pos IS NULL THEN 'unknown' WHEN o.pos >= j.pos THEN 'later' WHEN o.grp <> j.grp THEN 'group' END AS problem
  FROM deps d JOIN j USING (name) LEFT JOIN j o ON o.name = d.dep)
SELECT * FROM twice UNION ALL SELECT * FROM met WHERE problem IS NOT NULL""")
def job_checks(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 500 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).cast("string")
    jobs = o.select(name.alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("grp"))
    dep = (F.col("pos") - F.when(F.col("pos") % 7 == 0, -3).otherwise(4)).cast("string")
    return report.job_problems(jobs, jobs.filter("pos % 20 = 3 or pos % 70 = 0").select("name", dep.alias("dep")))


@query("SELECT 'run-' || l_suppkey AS run, 'run-' || l_suppkey || '/checkpoint-' || max(l_orderkey) AS path FROM lineitem GROUP BY l_suppkey")
def newest_checkpoints(spark, sf_dir):
    run = F.concat(F.lit("run-"), F.col("l_suppkey").cast("string"))
    rows = read_table(spark, sf_dir, "lineitem").select(run.alias("run"), F.concat(run, F.lit("/checkpoint-"), F.col("l_orderkey").cast("string")).alias("path"))
    return report.latest_checkpoint(rows.unionByName(rows.select("run", F.concat("run", F.lit("/latest")).alias("path")).distinct()))


@query(f"""WITH {P}, {ACCURACY}, {st.COSTS_SQL}
SELECT 'arm' AS section, arm AS name, 'accuracy' AS key, round(accuracy, 9) AS value FROM acc
UNION ALL SELECT 'cost', arm, 'fixed_usd', round(fixed_s::DOUBLE * {st.GPU_HOUR}::DOUBLE / 3600, 9) FROM costs
UNION ALL SELECT 'cost', arm, 'marginal_usd_per_query', round(query_s::DOUBLE * {st.GPU_HOUR}::DOUBLE / 3600, 12) FROM costs
UNION ALL SELECT 'item', CAST(question_id AS VARCHAR), 'answer_idx', answer_idx::DOUBLE FROM (SELECT * FROM gold ORDER BY md5('42|' || question_id), question_id LIMIT 20)""")
def demo_payload(spark, sf_dir):
    """The parts of a demonstration's payload as rows: arms, the two numbers of each cost curve, items."""
    row = lambda section, name, key, value: [F.lit(section).alias("section"), name.cast("string").alias("name"), F.lit(key).alias("key"), value.cast("double").alias("value")]
    arm, costs = F.col("arm"), store(st.cost_rows(spark, sf_dir), "costs")
    usd = lambda c: sc.usd(F.col(c), st.GPU_HOUR)
    rows = _accuracy(spark, sf_dir).select(*row("arm", arm, "accuracy", F.round("accuracy", 9)))
    rows = rows.unionByName(costs.select(*row("cost", arm, "fixed_usd", F.round(usd("fixed_s"), 9))))
    rows = rows.unionByName(costs.select(*row("cost", arm, "marginal_usd_per_query", F.round(usd("query_s"), 12))))
    items = split.sample_rows(st.gold(spark, sf_dir), 20, key="question_id")
    return rows.unionByName(items.select(*row("item", F.col("question_id"), "answer_idx", F.col("answer_idx"))))


SAMPLED = "(SELECT * FROM gold ORDER BY md5('42|' || question_id), question_id LIMIT 20)"


@query(f"""WITH {P}, {ACCURACY}, {st.COSTS_SQL}, i AS (SELECT count(*) AS n_items, sha256(string_agg(CAST(question_id AS VARCHAR), chr(10) ORDER BY CAST(question_id AS VARCHAR))) AS split_sha256, CAST(sum(answer_idx) AS BIGINT) AS answers FROM {SAMPLED})
SELECT (SELECT count(*) FROM acc) AS n_arms, (SELECT round(sum(accuracy), 6) FROM acc) AS accuracies, (SELECT round(sum(fixed_s), 6) FROM costs) AS fixed_s, answers,
  n_items, split_sha256, 42 AS seed, NULL::VARCHAR AS git, 'cpu' AS device FROM i""")
def payload_document(spark, sf_dir):
    """The payload as one committed JSON document with its provenance, read again."""
    items = split.sample_rows(st.gold(spark, sf_dir), 20, key="question_id")
    made = report.payload(_accuracy(spark, sf_dir), st.cost_rows(spark, sf_dir), items, seed=42, device="cpu")
    commits.commit(made, path := _path(spark, "payload"), form="json")
    sum_of = lambda column, of: F.aggregate(column, F.lit(0.0), lambda s, x: s + x[of])
    return commits.read(spark, path).select(
        F.size("arms").cast("long").alias("n_arms"), F.round(sum_of("arms", "accuracy"), 6).alias("accuracies"), F.round(sum_of("costs", "fixed_s"), 6).alias("fixed_s"),
        sum_of("items", "answer_idx").cast("long").alias("answers"), "provenance.*",
    )


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 < 2")
def shard_scan(spark, sf_dir):
    """Two columns of two of three shards; nothing else is read."""
    path = _path(spark, "shards")
    read_table(spark, sf_dir, "documents").withColumn("shard", F.col("doc_id") % 3).write.partitionBy("shard").parquet(path)
    return files.read_shards(spark, [f"{path}/shard={k}" for k in (0, 1)], ["doc_id", "source"])


@query("""SELECT source, round(count(*) FILTER (n_chars >= 3000) / count(*)::DOUBLE, 9) AS capped_share, round(avg(n_chars), 6) AS mean_chars,
  round(coalesce(count(*) FILTER (lang = 'en') / nullif(count(*) FILTER (lang = 'de'), 0)::DOUBLE, 0), 9) AS per_german FROM documents GROUP BY source""")
def guarded_ratios(spark, sf_dir):
    n, rows = F.count(F.lit(1)), read_table(spark, sf_dir, "documents").groupBy("source")
    of = lambda lang: F.count_if(F.col("lang") == lang)
    return rows.agg(
        F.round(sc.share(F.count_if(F.col("n_chars") >= 3000), n), 9).alias("capped_share"), F.round(sc.share(F.sum("n_chars"), n), 6).alias("mean_chars"),
        F.round(sc.share(of("en"), of("de")), 9).alias("per_german"),
    )


ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(z) - lgamma(n + 1)) / (2 * n + 1)))"


@query(f"""WITH {P}, met AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.ok AS x, b.ok AS y FROM preds a JOIN preds b ON a.question_id = b.question_id AND a.ord < b.ord),
t AS (SELECT arm_a, arm_b, count(*) FILTER (x AND NOT y) AS a, count(*) FILTER (y AND NOT x) AS b, avg(CAST(x AS DOUBLE)) - avg(CAST(y AS DOUBLE)) AS delta FROM met GROUP BY ALL),
s AS (SELECT *, a + b AS n, least(a, b) AS k, sqrt(pow(abs(a - b) - 1, 2) / greatest(a + b, 1)::DOUBLE / 2) AS z FROM t),
p AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))))
  WHEN z > 4 THEN 0 ELSE 1 - {ERF} END AS p FROM s)
SELECT arm_a || ' vs ' || arm_b AS comparison, printf('%+.3f', delta) AS delta_accuracy, a || '/' || b AS discordant, CASE WHEN p < 1e-4 THEN '<0.0001' ELSE printf('%.4f', p) END AS p,
  CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM p""")
def comparison_report(spark, sf_dir):
    return report.comparison_rows(stats.mcnemar(stats.mcnemar_counts(_ok(spark, sf_dir), ARMS)))
