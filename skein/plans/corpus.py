"""Queries on texts: cleaning, deduplication, mining, chunking, splits and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import scores as sc
from ..functions import text as tx
from ..operators import clean, retrieval, split
from ..sources.scratch import store
from ..sources.tables import read_table
from . import standins as st
from .registry import query

LEXICON = clean.OVERRIDES | {"hea": "heart"}
#: SQL of Unicode white space for DuckDB's patterns, and of its stripping and folding.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def hash_sql(q: str, options: list[str]) -> str:
    return "sha256(" + f" || '{tx.PART_MARK}' || ".join(f"lower({strip_sql(x)})" for x in [q, *options]) + ")"


def repair_sql(x: str) -> str:
    pieces = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    table = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEXICON.items()) + " END"
    return (
        f"array_to_string(list_transform({pieces}, lambda w: CASE WHEN {table} IS NULL THEN w "
        f"WHEN w = upper(w) AND length(w) > 1 THEN upper({table}) "
        f"WHEN w[1] <> lower(w[1]) THEN upper({table}[1]) || substr({table}, 2) ELSE {table} END), '')"
    )


def repaired_sql(x: str) -> str:
    keys = ", ".join(f"'{k}'" for k in LEXICON)
    pieces = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    return f"list_filter({pieces}, lambda w: lower(w) IN ({keys}))"


def plain_sql(c: str) -> str:
    return f"CASE WHEN lower({strip_sql(f'coalesce({c}, {chr(39) * 2})')}) = 'none' THEN '' ELSE {strip_sql(f'coalesce({c}, {chr(39) * 2})')} END"


FIELDS = ("question", *clean.OPTIONS, "exp")
CLEANED = f"""{st.QUESTIONS},
plain AS (SELECT id, pos, cop, choice_type, subject_name, {", ".join(f"{plain_sql(c)} AS {c}" for c in FIELDS)} FROM questions),
fixed AS (SELECT id, pos, cop, choice_type, subject_name, {", ".join(f"{repair_sql(c)} AS {c}" for c in FIELDS)},
  {" + ".join(f"length({repaired_sql(c)})" for c in FIELDS)} AS n_repaired FROM plain),
hashed AS (SELECT *, {hash_sql("question", list(clean.OPTIONS))} AS hash,
  CASE WHEN question = '' OR opa = '' OR opb = '' OR opc = '' OR opd = '' THEN 'malformed' WHEN cop = -1 THEN 'unlabelled' END AS early FROM fixed),
cleaned AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY hash, early IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE 'kept' END) AS status FROM hashed)"""


def _cleaned(spark, sf_dir):
    return clean.clean_questions(st.questions(spark, sf_dir), LEXICON)


@query(f"""WITH {CLEANED} SELECT count(*) AS rows_seen, count(*) FILTER (status = 'kept') AS rows_kept,
  count(*) FILTER (status = 'kept' AND n_repaired > 0) AS rows_modified, CAST(sum(n_repaired) AS BIGINT) AS tokens_repaired,
  count(*) FILTER (status = 'duplicate') AS duplicates_dropped, count(*) FILTER (status = 'unlabelled') AS unlabelled_dropped,
  count(*) FILTER (status = 'malformed') AS malformed_dropped, count(*) FILTER (choice_type = 'multi') AS choice_type_normalised FROM cleaned""")
def clean_status_report(spark, sf_dir):
    return clean.cleaning_report(_cleaned(spark, sf_dir))


@query(f"WITH {CLEANED} SELECT id, hash, status, n_repaired, CAST(cop AS INTEGER) AS answer_idx, nullif(exp, '') AS explanation FROM cleaned")
def clean_questions(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("id", "hash", "status", "n_repaired", F.coalesce("answer_idx", F.lit(-1)).alias("answer_idx"), "explanation")


@query(f"WITH {st.QUESTIONS} SELECT id, {repair_sql('exp')} AS repaired FROM questions")
def lexicon_repair(spark, sf_dir):
    return st.questions(spark, sf_dir).select("id", tx.repair(F.col("exp"), LEXICON).alias("repaired"))


@query(f"WITH {st.QUESTIONS} SELECT lower(w) AS token, count(*) AS n FROM (SELECT unnest({repaired_sql('exp')}) AS w FROM questions) GROUP BY 1")
def repair_tally(spark, sf_dir):
    rows = st.questions(spark, sf_dir).select(F.explode(tx.repaired_words(F.col("exp"), LEXICON)).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


COUNTS = "counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1)"


@query(f"WITH {COUNTS} SELECT * FROM counts")
def token_frequencies(spark, sf_dir):
    return clean.word_counts(read_table(spark, sf_dir, "documents"))


@query(f"WITH {CLEANED} SELECT hash, min(pos) AS first_pos, count(*) AS n FROM cleaned WHERE early IS NULL GROUP BY hash")
def content_hash_dedup(spark, sf_dir):
    rows = clean.checked_questions(st.questions(spark, sf_dir), LEXICON).filter("status is null")
    return rows.groupBy("hash").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def unique_documents(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").groupBy("text")
    return rows.agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query(f"WITH d AS (SELECT doc_id, lower({fold_sql('text')}) AS q FROM documents) SELECT q, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY q HAVING count(*) > 1")
def norm_dup_pairs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", tx.norm(F.col("text")).alias("q"))
    return rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


QUOTE_SQL = """['"‘’]?""".replace("'", "''")
LEAD_SQL = rf"(?i)^\s*ans(?:wer)?\.?\s*(?:is)?\s*{QUOTE_SQL}[a-e]{QUOTE_SQL}\s+(\()"
PREFIX_SQL = rf"(?i)^\s*(?:ans(?:wer)?\.?\s*(?:is)?\s*)?[:\-]?\s*{QUOTE_SQL}[a-e]{QUOTE_SQL}\s*(?:[.):,\-]|i\.?\s*e\.?)[,.\s]*"


def key_sql(columns: str, text: str, rows: str) -> str:
    """Rows (columns, stripped) of texts without their answer keys."""
    return (
        rf"SELECT {columns}, CASE WHEN regexp_matches(k, '(?i)^\s*(?:ref(?:erence)?s?\b|see\s+ref)') THEN '' ELSE k END AS stripped"
        rf" FROM (SELECT {columns}, {strip_sql(f"regexp_replace(regexp_replace(t, '{LEAD_SQL}', '{chr(92)}1'), '{PREFIX_SQL}', '')")} AS k"
        f" FROM (SELECT {columns}, {strip_sql(text)} AS t FROM {rows}))"
    )


KEY_SQL = key_sql("doc_id, kind", "p || text", "documents, (VALUES (0, ''), (1, 'Ans. B: '), (2, 'Answer is A ('), (3, 'Ref - ')) v(kind, p)")


@query(KEY_SQL)
def answer_key_strip(spark, sf_dir):
    openings = F.array(*map(F.lit, ("", "Ans. B: ", "Answer is A (", "Ref - ")))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(openings).alias("kind", "p"), "text")
    return rows.select("doc_id", "kind", tx.strip_answer_key(F.concat("p", "text")).alias("stripped"))


GOLDS = ("All of the above", "B>A>D>C", "1, 2 and 3", "A. x B. y C. z", "Both of the above", "neither a nor b", "option b is right", "a, b true", "None", "3.1", "3-5%", "Both GH and prolactin")


OPTION_SQL = " ".join(f"WHEN regexp_matches(gold, '{rule}') THEN '{name}'" for name, rule in tx.OPTION_RULES)
GOLD_LIST = ", ".join(f"'{g}'" for g in GOLDS)


@query(f"""WITH {st.QUESTIONS}, golds AS (SELECT id, CASE WHEN {st.h('"og"', "id")} % 4 = 0
  THEN list_extract([{GOLD_LIST}], CAST(1 + {st.h('"oh"', "id")} % {len(GOLDS)} AS BIGINT)) ELSE opa END AS gold FROM questions)
SELECT id, CASE {OPTION_SQL} END AS reason FROM golds""")
def option_dependent_flag(spark, sf_dir):
    golds = F.array(*map(F.lit, GOLDS))
    rows = st.questions(spark, sf_dir).select("id", F.when(sc.draw("og", F.col("id")) % 4 == 0, F.get(golds, (sc.draw("oh", F.col("id")) % len(GOLDS)).cast("int"))).otherwise(F.col("opa")).alias("gold"))
    return rows.select("id", tx.option_dependent(F.col("gold")).alias("reason"))


def chunks_sql(rows: str, size: int = 600, overlap: int = 100, least: int = 40) -> str:
    """CTEs up to chunked (doc_id, pos, chunk) of rows (doc_id, text).

    A walk over each text's sentences takes one step a row: it cuts what is too long, else takes
    the next sentence, else ends.
    """
    return f"""folded AS (SELECT doc_id, {fold_sql("text")} AS t FROM {rows}),
sents AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM folded WHERE length(t) > {size}),
walk(doc_id, i, cur, chunk, step, more) AS (SELECT doc_id, 1, '', NULL::VARCHAR, 0, true FROM sents
  UNION ALL SELECT doc_id, CASE WHEN long OR s IS NULL THEN i ELSE i + 1 END,
    CASE WHEN long THEN trim(substr(cur, {size - overlap + 1})) WHEN filled THEN trim(rest || ' ' || s) WHEN cur = '' THEN s ELSE cur || ' ' || s END,
    CASE WHEN long THEN cur[:{size}] WHEN s IS NULL OR filled THEN cur END, step + 1, long OR s IS NOT NULL
  FROM (SELECT w.*, ss[i] AS s, length(cur) > {2 * size} AS long, cur <> '' AND length(cur) + 1 + length(ss[i]) > {size} AS filled,
    CASE WHEN contains(right(cur, {overlap}), ' ') THEN substr(right(cur, {overlap}), strpos(right(cur, {overlap}), ' ') + 1) ELSE '' END AS rest
    FROM walk w JOIN sents USING (doc_id) WHERE more)),
pieces AS (SELECT doc_id, trim(chunk) AS chunk, step FROM walk WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, t, 0 FROM folded WHERE length(t) <= {size}),
chunked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS pos, chunk FROM pieces WHERE length(chunk) >= {least})"""


def numbered_sql(prefix: str) -> str:
    """CTE corpus (index, id, doc_id, text) of chunked."""
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS index FROM chunked),
corpus AS (SELECT index, '{prefix}-' || lpad(CAST(index AS VARCHAR), 8, '0') || '-' || left(sha1(chunk), 12) AS id, doc_id, chunk AS text FROM placed)"""


@query(f"WITH RECURSIVE {chunks_sql('documents')} SELECT * FROM chunked")
def chunk_documents(spark, sf_dir):
    return retrieval.chunk_rows(read_table(spark, sf_dir, "documents"))


@query(f"WITH RECURSIVE {chunks_sql('documents')}, {numbered_sql('external')} SELECT index, id, doc_id FROM corpus")
def chunk_ids(spark, sf_dir):
    return retrieval.build_corpus(read_table(spark, sf_dir, "documents"), prefix="external").select("index", "id", "doc_id")


@query(f"""WITH RECURSIVE {chunks_sql("documents")}
SELECT count(*) AS chunks, count(DISTINCT doc_id) AS source_documents, CAST(sum(length(chunk)) AS BIGINT) AS total_chars, round(avg(length(chunk)), 9) AS mean_chars FROM chunked""")
def corpus_stats(spark, sf_dir):
    rows = retrieval.chunk_rows(read_table(spark, sf_dir, "documents")).withColumnRenamed("chunk", "text")
    return retrieval.corpus_stats(rows).withColumn("mean_chars", F.round("mean_chars", 9))


@query(f"WITH RECURSIVE {chunks_sql('documents')}, {numbered_sql('capped')} SELECT index, id FROM corpus WHERE index < 1000")
def corpus_cap(spark, sf_dir):
    return retrieval.build_corpus(read_table(spark, sf_dir, "documents"), prefix="capped", cap=1000).select("index", "id")


PARITY = f"""{CLEANED}, allowed AS (SELECT id, exp FROM cleaned WHERE status = 'kept' AND exp <> ''
  AND hash NOT IN (SELECT hash FROM cleaned WHERE status = 'kept' AND {st.h('"held"', "id")} % 10 = 0)),
sources AS (SELECT id AS doc_id, stripped AS text FROM ({key_sql("id", "exp", "allowed")}) WHERE stripped <> '')"""


@query(f"WITH RECURSIVE {PARITY}, {chunks_sql('sources')}, {numbered_sql('parity')} SELECT index, id, doc_id FROM corpus")
def parity_corpus(spark, sf_dir):
    rows = store(_cleaned(spark, sf_dir).filter("status = 'kept'").select("id", "hash", "explanation"), "kept")  # read twice
    banned = rows.filter(sc.draw("held", F.col("id")) % 10 == 0).select("hash")
    return retrieval.explanation_corpus(rows, banned).select("index", "id", "doc_id")


TEXT_HASH = f"sha256(lower({strip_sql('text')}))"


@query(f"""WITH d AS (SELECT doc_id AS id, {TEXT_HASH} AS hash, {st.h('"ev"', "doc_id")} % 10 = 0 AS held FROM documents),
e AS (SELECT hash, max(id) AS eval_id FROM d WHERE held GROUP BY hash)
SELECT d.id AS train_id, eval_id FROM d JOIN e USING (hash) WHERE NOT held""")
def train_leakage(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    return clean.train_leakage(rows.filter("not held"), rows.filter("held"))


@query(f"""WITH d AS (SELECT doc_id AS id, {TEXT_HASH} AS hash, {st.h('"ev"', "doc_id")} % 10 = 0 AS held FROM documents)
SELECT id FROM d WHERE NOT held AND hash NOT IN (SELECT hash FROM d WHERE held)""")
def heldout_anti_join(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    return clean.without_held_out(rows.filter("not held"), rows.filter("held")).select("id")


def _hashed(spark, sf_dir):
    hash_ = F.sha2(F.lower(tx.strip(F.col("text"))), 256)
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), hash_.alias("hash"), (sc.draw("ev", F.col("doc_id")) % 10 == 0).alias("held"))


def quota_sql(want: int, name: str) -> str:
    return f"""(n * {want} // total) + CASE WHEN row_number() OVER (ORDER BY (n * {want}) % total DESC, subject)
      <= {want} - sum(n * {want} // total) OVER () THEN 1 ELSE 0 END AS {name}"""


SPLIT = f"""{st.GOLD}, per AS (SELECT subject, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM gold GROUP BY subject),
q AS (SELECT subject, {quota_sql(100, "n_test")}, {quota_sql(50, "n_val")} FROM per),
split AS (SELECT question_id AS id, subject, CASE WHEN p <= n_test THEN 'test' WHEN p <= n_test + n_val THEN 'val' ELSE 'reserve' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('42|' || question_id), question_id) AS p FROM gold) JOIN q USING (subject))"""


def _split(spark, sf_dir):
    rows = st.gold(spark, sf_dir).withColumnRenamed("question_id", "id")
    return split.stratified_split(rows, stratum="subject", test=100, val=50)


@query(f"WITH {SPLIT} SELECT * FROM split")
def split_stratified(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "subject", "split")


@query(f"WITH {SPLIT} SELECT subject, CAST(n_test AS BIGINT) AS n_test, CAST(n_val AS BIGINT) AS n_val FROM q")
def split_quota(spark, sf_dir):
    return split.quotas(st.gold(spark, sf_dir), "subject", {"n_test": 100, "n_val": 50}).drop("n")


DIGEST = "SELECT split, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR))) AS digest FROM split GROUP BY split"


@query(f"WITH {SPLIT} {DIGEST}")
def split_digest(spark, sf_dir):
    return split.id_digest(_split(spark, sf_dir), "split")


@query(f"WITH {SPLIT} SELECT id FROM split GROUP BY id HAVING count(DISTINCT split) > 1")
def split_disjoint(spark, sf_dir):
    return split.shared_ids(_split(spark, sf_dir)).select("id")


@query(f"""WITH {SPLIT}, actual AS ({DIGEST})
SELECT split, CASE split WHEN 'test' THEN 'digest' ELSE 'count' END AS problem FROM actual WHERE split IN ('test', 'val')""")
def manifest_verify(spark, sf_dir):
    made = _split(spark, sf_dir)
    told = split.id_digest(made, "split")
    told = told.withColumn("digest", F.when(F.col("split") == "test", "0" * 64).otherwise(F.col("digest")))
    told = told.withColumn("n", F.when(F.col("split") == "val", F.col("n") + 1).otherwise(F.col("n")))
    return split.verify_manifest(made, told)


HOLDOUT = f"""{st.PAIRS}, normed AS (SELECT *, lower({fold_sql("question")}) AS q, lower({fold_sql("answer")}) AS a FROM pairs),
firsts AS (SELECT * FROM normed QUALIFY row_number() OVER (PARTITION BY q, a ORDER BY pos, id) = 1),
sized AS (SELECT * FROM firsts QUALIFY count(*) OVER (PARTITION BY passage) >= 2),
groups AS (SELECT passage, coalesce(sum(count(*) - 1) OVER (ORDER BY md5('42|' || passage), passage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized GROUP BY passage),
taken AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY md5('42|' || id), id) = 1 AS held FROM sized WHERE passage IN (SELECT passage FROM groups WHERE before < 400)),
tests AS (SELECT * FROM taken WHERE held AND q NOT IN (SELECT q FROM taken WHERE NOT held) QUALIFY row_number() OVER (ORDER BY md5('43|' || id), id) <= 50),
parted AS (SELECT id, passage, 'train' AS split FROM taken WHERE NOT held UNION ALL SELECT id, passage, 'test' FROM tests)"""


@query(f"WITH {HOLDOUT} SELECT * FROM parted")
def group_holdout_split(spark, sf_dir):
    return split.grouped_holdout(st.pairs_by_passage(spark, sf_dir), n_train=400, n_test=50)


@query(f"""WITH {HOLDOUT}, t AS (SELECT p.*, n.q, n.a FROM parted p JOIN normed n USING (id, passage))
SELECT (SELECT count(*) FROM t x JOIN t y ON x.id = y.id AND x.split = 'train' AND y.split = 'test') AS shared_ids,
  (SELECT count(*) FROM t WHERE split = 'test' AND q IN (SELECT q FROM t WHERE split = 'train')) AS shared_questions,
  (SELECT count(*) FROM t WHERE split = 'test' AND passage NOT IN (SELECT passage FROM t WHERE split = 'train')) AS unsupported""")
def leakage_assertions(spark, sf_dir):
    pairs = st.pairs_by_passage(spark, sf_dir)
    made = split.grouped_holdout(pairs, n_train=400, n_test=50).join(pairs.select("id", tx.norm(F.col("question")).alias("q")), "id")
    train, test = made.filter("split = 'train'"), made.filter("split = 'test'")
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    ids = one(test.join(train.select("id"), "id", "left_semi"), "shared_ids")
    asked = one(test.join(train.select("q"), "q", "left_semi"), "shared_questions")
    lost = one(test.join(train.select("passage"), "passage", "left_anti"), "unsupported")
    return ids.crossJoin(asked).crossJoin(lost)


@query(f"""WITH {st.GOLD} SELECT question_id FROM gold ORDER BY md5('42|' || question_id), question_id LIMIT 100""")
def sft_subsample(spark, sf_dir):
    return split.sample_rows(st.gold(spark, sf_dir), 100, key="question_id").select("question_id")


@query("""SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def sft_records(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), said.alias("rendered"))


OPTIONS_SQL = "'A. ' || opa || chr(10) || 'B. ' || opb || chr(10) || 'C. ' || opc || chr(10) || 'D. ' || opd"
PROMPT_SQL = f"{strip_sql('question')} || chr(10) || chr(10) || {OPTIONS_SQL} || chr(10) || chr(10) || '{pr.INSTRUCTION}'"


@query(f"WITH {st.QUESTIONS} SELECT id, {PROMPT_SQL} AS prompt FROM questions")
def prompt_mcq(spark, sf_dir):
    rows = st.questions(spark, sf_dir)
    return rows.select("id", pr.mcq_prompt(F.col("question"), F.array(*clean.OPTIONS)).alias("prompt"))


@query(f"""WITH {st.QUESTIONS}, p AS (SELECT id, {PROMPT_SQL} AS plain, {strip_sql("exp")} AS passage FROM questions)
SELECT id, true AS same, length(plain) + length(passage) + {len(pr.CONTEXT_HEADER) + 2 + 4 + len(pr.SEPARATOR)} AS n_chars FROM p""")
def prompt_strip_roundtrip(spark, sf_dir):
    rows = st.questions(spark, sf_dir)
    plain = pr.mcq_prompt(F.col("question"), F.array(*clean.OPTIONS))
    full = pr.mcq_prompt(F.col("question"), F.array(*clean.OPTIONS), F.array("exp"))
    rows = rows.select("id", plain.alias("plain"), full.alias("full"))
    return rows.select("id", (pr.strip_context(F.col("full")) == F.col("plain")).alias("same"), F.length("full").cast("long").alias("n_chars"))


@query(f"WITH {st.QUESTIONS} SELECT id, question || ' ' || opa || ' ' || opb || ' ' || opc || ' ' || opd AS query FROM questions")
def query_text(spark, sf_dir):
    return st.questions(spark, sf_dir).select("id", pr.query_text(F.col("question"), F.array(*clean.OPTIONS)).alias("query"))


@query("""SELECT doc_id, text AS reply FROM documents""")
def chat_reply_json(spark, sf_dir):
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    response = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", response.alias("response"))
    return rows.select("doc_id", tx.extract_reply(F.col("response")).alias("reply"))


#: The letter pairs that extraction is known to drop.
DROPPED_PAIRS = ("rt", "ti", "ol", "id", "iv", "it", "at")
#: The dictionary, as no list of words is given: three quarters, by hash, of the words that occur five times or more.
DICTIONARY = f"dictionary AS MATERIALIZED (SELECT word FROM counts WHERE n >= 5 AND {st.h('\"dict\"', 'word')} % 4 <> 0)"


def _mined(spark, sf_dir):
    """Words with their counts, stored so that the texts are read once, and the dictionary."""
    counts = store(clean.word_counts(read_table(spark, sf_dir, "documents")), "counts")
    return counts, counts.filter((F.col("n") >= 5) & (sc.draw("dict", F.col("word")) % 4 != 0)).select("word")


REFUSED = " AND ".join(f"NOT (token = '{a}' AND repair = '{b}')" for a, b in clean.REJECTED.items())


def proposals_sql(length: int, pairs: tuple[str, ...]) -> str:
    """CTEs of ``proposals``: insertions are joined to the whole dictionary by hash, and counted by groups."""
    listed = ", ".join(f"({k}, '{p}')" for k, p in enumerate(pairs))
    return f"""{COUNTS.replace(" AS (", " AS MATERIALIZED (", 1)}, {DICTIONARY},
tokens AS MATERIALIZED (SELECT c.word AS token, c.n FROM counts c LEFT JOIN dictionary d ON d.word = c.word WHERE d.word IS NULL AND c.n >= 20 AND length(c.word) >= {length}),
places AS MATERIALIZED (SELECT token, n, unnest(range(1, length(token) + 1)) AS i FROM tokens),
tried AS MATERIALIZED (SELECT token, n, k, pair, substr(token, 1, i) || pair || substr(token, i + 1) AS repair FROM places, (VALUES {listed}) p(k, pair)),
hits AS (SELECT token, n, min(repair) AS repair, max(repair) AS other, arg_min(pair, k) AS pair FROM tried t JOIN dictionary d ON d.word = t.repair GROUP BY token, n),
proposals AS (SELECT token, repair, pair, h.n, coalesce(c.n, 0) AS n_correct FROM hits h LEFT JOIN counts c ON c.word = h.repair WHERE h.repair = h.other AND coalesce(c.n, 0) >= 0.3 * h.n AND {REFUSED})"""


OVERRIDE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in clean.OVERRIDES.items())


@query(f"WITH {proposals_sql(2, DROPPED_PAIRS)} SELECT * FROM proposals")
def repair_proposals(spark, sf_dir):
    """Proposals for review, of all seven pairs."""
    return clean.propose_repairs(*_mined(spark, sf_dir), pairs=DROPPED_PAIRS)


@query(f"""WITH {proposals_sql(3, DROPPED_PAIRS[:1])}, fixed(token, repair) AS (VALUES {OVERRIDE_ROWS})
SELECT p.token, p.repair, pair, n, n_correct FROM proposals p LEFT JOIN fixed f ON f.token = p.token WHERE f.token IS NULL
UNION ALL SELECT f.token, f.repair, NULL, coalesce(a.n, 0), coalesce(b.n, 0) FROM fixed f LEFT JOIN counts a ON a.word = f.token LEFT JOIN counts b ON b.word = f.repair""")
def mine_lexicon(spark, sf_dir):
    """The lexicon of the one pair that is repaired."""
    return clean.build_lexicon(*_mined(spark, sf_dir))


WIDE = """wide AS MATERIALIZED (SELECT word AS token, reverse(word) AS repair FROM counts WHERE length(word) >= 4 AND n % 3 = 0)"""
PIECES = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"


@query(rf"""WITH {COUNTS}, {WIDE}, cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '{PIECES}') AS ws FROM documents),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM cut),
cased AS (SELECT r, i, w, repair, CASE WHEN repair IS NULL THEN w WHEN w = upper(w) AND length(w) > 1 THEN upper(repair) WHEN w[1] <> lower(w[1]) THEN upper(repair[1]) || substr(repair, 2) ELSE repair END AS said
  FROM words LEFT JOIN wide ON token = lower(w)),
joined AS (SELECT r, count(repair) AS n_repaired, string_agg(said, '' ORDER BY i) AS t FROM cased GROUP BY r)
SELECT doc_id, coalesce(n_repaired, 0) AS n_repaired, sha256(coalesce(t, '')) AS sha256 FROM cut LEFT JOIN joined USING (r)""")
def wide_lexicon_repair(spark, sf_dir):
    """Repair by a lexicon that grows with the corpus: a third of its words, spelt backwards."""
    docs = read_table(spark, sf_dir, "documents")
    wide = clean.word_counts(docs).filter("length(word) >= 4 and n % 3 = 0").select(F.col("word").alias("token"), F.reverse("word").alias("repair"))
    made = clean.repair_rows(docs.select("doc_id", "text"), ["text"], wide, key="doc_id")
    return made.select("doc_id", F.coalesce("text_told.n", F.lit(0)).cast("long").alias("n_repaired"), F.sha2(F.coalesce("text_told.text", F.lit("")), 256).alias("sha256"))


@query(f"""WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS query FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, query), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM v, q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score
FROM s QUALIFY rank <= 5""")
def vector_topk(spark, sf_dir):
    out = _topk(spark, sf_dir)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS query FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, query), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM v, q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score
FROM s QUALIFY rank <= 5""")
def vector_topk_pruned(spark, sf_dir):
    """The same rows as ``vector_topk``, with clusters skipped whose bound is under the k-th score."""
    out = _pruned(spark, sf_dir)[0]
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query()
def vector_topk_skipped(spark, sf_dir):
    """How many products the bounds skip."""
    return _pruned(spark, sf_dir)[1]


def _pruned(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.CellIndex(v).top_k(q, 5)


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS query FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, query), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM v, q),
r AS (SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)
SELECT query_id, vec_id FROM r WHERE score >= 0.3""")
def vector_min_score(spark, sf_dir):
    return _topk(spark, sf_dir, 0.3).select("query_id", "vec_id")


def _topk(spark, sf_dir, least=None):
    v = read_table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k(q, v, 5, least=least)


@query("""WITH p AS (SELECT conv_id AS query_id, turn AS rank, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum_chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT query_id, rank, CAST(cum_chars AS BIGINT) AS cum_chars FROM p WHERE place = 1 OR cum_chars <= 1500""")
def context_budget(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return retrieval.within_budget(rows, 1500).select("query_id", "rank", "cum_chars")
