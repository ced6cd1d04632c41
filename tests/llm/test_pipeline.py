"""The stages one after another on the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skein.llm import queries
from skein.sources.tables import read_table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = read_table(spark, DATA, "documents")
    names, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == names, name
        rows.append(docs.count())
    assert rows[0] > rows[1] >= rows[2] >= rows[3] > 0
    assert docs.select("text").distinct().count() == docs.select("doc_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def odd_documents(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w30", "other")
    rows = [
        (5, words, "en", "a"), (3, words, "en", "a"), (3, words, "en", "a"), (9, near, "en", None), (None, None, None, None), (7, "", "de", "b"),
        (8, "é𝄞 " * 30_000, "de", "b"), (None, words, None, "a"), (11, " ".join(f"v{i}" for i in range(50)), None, "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit("s"), "key": F.lit(1), "kept": F.lit(True), "n": F.lit(2), "row": F.lit(0), "cutoffs": F.lit("c"), "h": F.lit(3), "piece": F.lit(4)})


#: What each stage keeps of them, by id.
KEPT = {
    "quality_rules": [None, 3, 3, 5, 9, 11],
    "exact_dedup": [3, 7, 8, 9, 11],
    "near_dedup": [None, None, 3, 3, 7, 8, 11],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, DATA)
    got = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda i: -1 if i is None else i)
    if name in KEPT:
        assert out.columns == docs.columns and got == KEPT[name]
    elif name == "source_mix":
        assert out.columns == docs.columns and 7 not in got and 8 in got
    else:
        assert set(got) == {None, 3, 5, 7, 8, 9, 11} and out.filter("doc_id = 7").first()["length"] == 1
    assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_return_their_columns(spark, name):
    want = {
        "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3": "doc_id size source_size target taken", "op4": "doc_id piece start length ids_crc32 sequence_id offset", "op5": "doc_id n_shingles component_id",
        "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op8": "page_id url text n_chars", "op9": "doc_id held_out score predicted", "op10": "doc_id keep_id group_size kept text_sha256", "op11": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op12": "sale_id slot level n_sales n_rows", "op13": "item_id rank doc_id score",
    }[name.split("_")[0]].split()
    made = queries.QUERIES[name](spark, DATA)
    assert set(want) <= set(made.columns)
    if name.startswith("op13"):
        per = made.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
        assert per.filter("n != last or n > 50").count() == 0 and per.count() == read_table(spark, DATA, "benchmark").count()
        return
    table = {"op1": "conversations", "op8": "pages", "op12": "sales"}.get(name.split("_")[0], "documents")
    rows = read_table(spark, DATA, table)
    n = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert made.count() == n or name.startswith("op4") and made.select("doc_id").distinct().count() == n
