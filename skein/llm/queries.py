"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import read_table
from . import chat, crf, dedup, dominance, htmltext, lattice, mixing, overlap, packing, pii, quality, suffixes, treaps


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and conversation -1, whose texts hold marks; read them back."""
    tables = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    events = tables.unionByName(odd).withColumns({"seq": F.col("turn"), "op": F.lit("message")})
    made = chat.format_chats(events)
    rows = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("read"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("lost"))
    whole = F.array_join(F.transform("read", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
           + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents; the labels certify the cutoffs of each language."""
    made = quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Base counts of the texts, then the certified step of each language and its cutoffs.
OP2_SQL = r"""
WITH split AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5_number_lower(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM split WHERE len(ws) > 7)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
counted AS (SELECT doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[\t-\r ]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\t-\r ]')) AS ls FROM split),
measured AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeats FROM counted LEFT JOIN covered USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeats > 30 * n_words AS base_failed,
  list_transform([n_symbols / greatest(word_chars, 1), n_bangs / greatest(word_chars, 1), n_upper / greatest(word_chars, 1), n_repeats / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1)],
    lambda x: CAST(least(ceil(x * 100), 100) AS INTEGER)) AS cells FROM measured),
told AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS MATERIALIZED (SELECT coalesce(lang, chr(0)) AS lang, cells, quality, ('0x' || substr(md5('29|' || doc_id), 1, 1))::UBIGINT % 2 = 0 AS tuning FROM judged JOIN told USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT range AS cut FROM range(0, 101)),
tried AS (SELECT lang, rule, cut, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 1 AND cell > cut) AS above_good, count(*) FILTER (quality = 0 AND cell > cut) AS above_bad
  FROM (SELECT lang, quality, unnest(cells) AS cell, unnest(range(1, 6)) AS rule FROM labelled WHERE tuning), grid GROUP BY ALL),
aims AS (SELECT lang, rule, arg_max(cut, (above_bad / greatest(n_bad, 1) - 25.0::DOUBLE * above_good / greatest(n_good, 1), cut)) AS aim FROM tried GROUP BY ALL),
aimed AS (SELECT lang, list(aim ORDER BY rule) AS aims FROM aims GROUP BY lang),
tests AS (SELECT lang, quality, list_max(list_transform(list_zip(cells, aims), lambda x: CASE WHEN x[1] > x[2] THEN CAST(ceil(100 * (x[1] - x[2]) / (100 - x[2])) AS INTEGER) ELSE 0 END)) AS cell FROM labelled JOIN aimed USING (lang) WHERE NOT tuning),
steps AS (SELECT lang, cut, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 1 AND cell > cut) AS k, count(*) FILTER (quality = 0 AND cell > cut) AS above_bad FROM tests, grid GROUP BY ALL),
bounds AS (SELECT *, k < n * 0.02::DOUBLE AND list_sum(list_transform(range(0, least(k, n) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE)))) <= 0.05::DOUBLE / (SELECT count(DISTINCT lang) FROM tests) AS passed FROM steps),
runs AS (SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY cut DESC) AS certified FROM bounds),
best AS (SELECT lang, arg_max(cut, (above_bad / greatest(n_bad, 1) - 25.0::DOUBLE * k / greatest(n, 1), cut)) AS step FROM runs WHERE certified GROUP BY lang),
cutoffs AS (SELECT lang AS stratum, list_transform(aims, lambda a: a + floor(step * (100 - a) / 100)) AS cuts FROM best JOIN aimed USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeats AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(list_bool_or(list_transform(list_zip(cells, cuts), lambda x: x[1] > x[2])), false) AS kept
FROM judged LEFT JOIN cutoffs ON stratum = coalesce(lang, chr(0))
"""


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 1, 2, 3."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


def op4_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=2048)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents by links of their shingle sets."""
    return overlap.jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in all documents."""
    made = pii.find_private(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return made.select("doc_id", *map(of, (*pii.KINDS, "id")), n_spans, F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"))


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; every seventh by hash is held out of the estimates."""
    return lattice.score_texts(read_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of all pages."""
    return htmltext.extract_pages(read_table(spark, sf_dir, "pages"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents for quality; every fifth by hash is held out of the fit."""
    return crf.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents by text; the largest id of a group stays."""
    return dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op11_suffix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the windows of all benchmark items in all documents."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    found = suffixes.find_leaks(read_table(spark, sf_dir, "documents"), benchmark)
    longest = F.array_max(F.transform("matches", lambda m: m["n_words"]))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest_words"),
    )


#: Windows meet by hash; the longest match with an item is the longest stretch of equal words around a window.
OP11_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wanted AS MATERIALIZED (SELECT item, k, w, j, md5(array_to_string(ws[j:j + w - 1], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS j FROM (SELECT *, least(len(ws), 10) AS w FROM items WHERE len(ws) > 0))),
windows AS (SELECT r, i, w, md5(array_to_string(ws[i:i + w - 1], ' ')) AS h FROM (SELECT r, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM split, (SELECT DISTINCT w FROM wanted) WHERE len(ws) >= w)),
met AS MATERIALIZED (SELECT r, i, x.w, item, k, j FROM windows x JOIN wanted y ON x.h = y.h AND x.w = y.w),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + w)) AS place FROM (SELECT DISTINCT r, i, w FROM met)) GROUP BY r),
told AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r),
runs AS (SELECT r, max(n) AS longest FROM (SELECT r, count(*) + any_value(w) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, k, i - j ORDER BY i) AS run FROM met) GROUP BY r, k, i - j, run) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_words
FROM split LEFT JOIN hits USING (r) LEFT JOIN told USING (r) LEFT JOIN runs USING (r)
"""


def op12_dominance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count for every sale those of no later day and a strictly higher total; NaN and infinite totals have no level."""
    sales = read_table(spark, sf_dir, "sales")
    sold, total = F.col("sold_at"), F.col("total")
    zoneless = isinstance(sales.schema["sold_at"].dataType, T.TimestampNTZType)
    slot = F.unix_date(sold.cast("date")) if zoneless else F.floor(F.unix_seconds(sold) / 86400)
    level = F.when(F.abs(total) < float("inf"), F.floor(F.floor(100 * total + 0.5) / 1000))
    rows = sales.select("sale_id", slot.cast("long").alias("slot"), level.alias("level"))
    each = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 3
    found = dominance.count_above(rows.withColumn("each", each), weight="each")
    return found.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("weight_above").alias("n_rows"))


#: CRC-32 bit by bit, then sums over all slots and levels, empty ones included.
OP12_SQL = r"""
WITH RECURSIVE wheel(i, step, v) AS (SELECT range, 0, CAST(range AS UBIGINT) FROM range(0, 256) UNION ALL SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM wheel WHERE step < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM wheel WHERE step = 8),
rows AS MATERIALIZED (SELECT sale_id, CAST(floor(floor(epoch(sold_at)) / 86400) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
  1 + xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(CAST(sale_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda s, c: xor(s >> 8, t[CAST(xor(s, c) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) % 3 AS each FROM sales, crcs),
cells AS (SELECT slot, level, count(*) AS n, sum(each) AS m FROM rows WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
grid AS (SELECT slot, level, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT DISTINCT slot FROM cells) CROSS JOIN (SELECT DISTINCT level FROM cells) LEFT JOIN cells USING (slot, level)),
along AS (SELECT slot, level, coalesce(sum(n) OVER higher, 0) AS n, coalesce(sum(m) OVER higher, 0) AS m FROM grid WINDOW higher AS (PARTITION BY slot ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
above AS (SELECT slot, level, CAST(sum(n) OVER earlier AS BIGINT) AS n_sales, CAST(sum(m) OVER earlier AS BIGINT) AS n_rows FROM along WINDOW earlier AS (PARTITION BY level ORDER BY slot ROWS UNBOUNDED PRECEDING))
SELECT sale_id, slot, level, n_sales, n_rows FROM rows LEFT JOIN above USING (slot, level)
"""


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank all documents for each benchmark item."""
    return treaps.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


#: Every document is scored for every item with which it shares a term.
OP13_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM split WHERE len(ws) > 0),
postings AS MATERIALIZED (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(ws) AS n, unnest(ws) AS term FROM split) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
impacts AS MATERIALIZED (SELECT doc_id, r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact FROM postings JOIN weights USING (term), totals),
scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts JOIN asked USING (term) GROUP BY item_id, r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: Sources share all words by weight; within a source expected copies go by the square root of the
#: size, whole ones are certain, and the rest is decided by the rank of random odds over inclusion odds.
OP3_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda w: w <> '')) AS size FROM documents),
placed AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighed AS (SELECT *, [1.0, 2.0, 3.0][k % 3 + 1]::DOUBLE AS weight, sum(source_size) OVER () AS all_words FROM placed),
levels AS (SELECT *, greatest(all_words - coalesce(3 * sum(source_size) OVER before, 0), 0)::DOUBLE / sum(weight) OVER after AS level FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fair AS (SELECT arg_min(level, (source_size / weight, k)) AS fair FROM levels WHERE level * weight <= 3 * source_size),
targets AS (SELECT source, source_size, CASE WHEN fair IS NULL THEN 3.0 * source_size ELSE least(3.0 * source_size, fair * weight) END::DOUBLE AS target FROM levels, fair),
by_size AS (SELECT source, size, count(*) AS n FROM sized GROUP BY ALL),
walked AS (SELECT b.source, source_size, target, size, (target - coalesce(sum(3.0 * size * n) OVER larger, 0)) / nullif(sum(size * n * sqrt(size)) OVER others, 0) AS scale
  FROM by_size b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
  WINDOW larger AS (PARTITION BY b.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), others AS (PARTITION BY b.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
scales AS (SELECT source, source_size, target, arg_max(greatest(scale, 0), size) FILTER (scale * sqrt(size) <= 3 * (1 + 1e-12)) AS scale FROM walked GROUP BY ALL),
wished AS (SELECT d.*, source_size, target, least(coalesce(scale * sqrt(size), 3), 3)::DOUBLE AS copies FROM sized d JOIN scales s ON d.source IS NOT DISTINCT FROM s.source),
parted AS (SELECT *, floor(copies + 1e-9) AS whole, greatest(copies - floor(copies + 1e-9), 0) AS extra,
  ((('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 13))::UBIGINT + 0.5) / 4503599627370496)::DOUBLE AS u FROM wished),
ranked AS (SELECT *, (u / (1 - u)) / (extra / (1 - extra)) AS q, target - sum(whole * size) OVER (PARTITION BY source) AS owed FROM parted),
cut AS (SELECT *, extra > 0 AND size > 0 AND coalesce(sum(size) OVER (PARTITION BY source, extra > 0 AND size > 0 ORDER BY q / (1 + q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= owed AS more FROM ranked)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM cut
"""

#: A walk through links reaches, from each text, the least document of its component.
OP5_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[	-
 ]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - 4, 1) + 1) END, lambda i: md5_number_lower(array_to_string(ws[i:i + 4], ' ')))) AS own FROM split),
keyed AS MATERIALIZED (SELECT doc_id, len(own) AS size, md5(CAST(list_sort(own) AS VARCHAR)) AS k FROM sets),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, k, any_value(size) AS size FROM keyed WHERE size > 0 GROUP BY k),
firsts AS MATERIALIZED (SELECT doc_id, unnest(own) AS s FROM sets SEMI JOIN classes ON rep = doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM firsts x JOIN firsts y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * n >= 75 * (x.size + y.size - n)),
reach(node, met) AS (SELECT rep, rep FROM classes UNION SELECT node, b FROM reach JOIN links ON a = met),
least AS (SELECT node, min(met) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(keyed.size AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM keyed LEFT JOIN classes USING (k) LEFT JOIN least ON node = rep
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mix": op3_source_mix,
    "op4_best_fit_pack": op4_best_fit_pack,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_context_pii": op6_context_pii,
    "op7_subword_lattice": op7_subword_lattice,
    "op8_main_text": op8_main_text,
    "op9_line_crf": op9_line_crf,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_suffix_decontaminate": op11_suffix_decontaminate,
    "op12_dominance_count": op12_dominance_count,
    "op13_treap_search": op13_treap_search,
}

ORACLES = {"op1_chat_format": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_source_mix": OP3_SQL, "op5_ngram_jaccard": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op11_suffix_decontaminate": OP11_SQL, "op12_dominance_count": OP12_SQL, "op13_treap_search": OP13_SQL}
