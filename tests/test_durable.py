"""Committed folders, stores and logs that survive an early end, and searches that skip clusters."""

import json
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import hooks, retrieval
from skein.sources import commits, files


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_commits_are_whole_or_absent(spark, tmp_path, form):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(k, None if k % 3 else f"t{k}", [k, 1]) for k in range(20)] + [(1, "x", None)] * 2, "id long, text string, more array<long>")
    with pytest.raises(ValueError, match="no manifest"):
        commits.read(spark, path)
    told = commits.commit(rows.repartition(3), path, form=form, facts={"seed": 42})
    assert (told["rows"], told["facts"]) == (22, {"seed": 42}) and commits.manifest(spark, path) == told
    assert sorted(map(str, commits.read(spark, path).collect())) == sorted(map(str, rows.collect()))
    assert commits.torn(spark, path).count() == 0
    # A write that ends before its manifest changes nothing for readers.
    rows.limit(3).write.format(form).save(f"{path}/data-unfinished")
    assert commits.read(spark, path).count() == 22
    # The next commit replaces the earlier one and deletes its data.
    commits.commit(rows.limit(5), path, form=form)
    assert commits.read(spark, path).count() == 5 and not Path(f"{path}/data-{told['data']}").exists()
    assert not [p for p in Path(path).iterdir() if re.match(r"MANIFEST.json\.", p.name)]


def test_torn_commits_are_refused(spark, tmp_path):
    path = str(tmp_path / "c")
    told = commits.commit(spark.range(100).repartition(4), path, form="json")
    one, two, *_ = sorted(Path(f"{path}/data-{told['data']}").glob("part-*"))
    text = one.read_text()
    for crc in Path(f"{path}/data-{told['data']}").glob(".*.crc"):
        crc.unlink()
    one.write_text(text.replace('"id":', '"id":1', 1))
    with pytest.raises(ValueError, match="digest"):
        commits.read(spark, path)
    one.write_text("\n".join(text.splitlines()[:-1]))
    with pytest.raises(ValueError, match="count"):
        commits.read(spark, path)
    one.write_text(text)
    two.rename(tmp_path / two.name)
    with pytest.raises(ValueError, match="missing"):
        commits.read(spark, path)
    (tmp_path / two.name).rename(two)
    two.with_name("part-x.json").write_text('{"id":7}\n')
    assert [tuple(r) for r in commits.torn(spark, path).collect()] == [("part-x.json", "unrecorded")]
    assert commits.read(spark, path, verify=False).count() == 101


def counting_encoder(folder, fails=()):
    def make():
        def encode(texts):
            if any(t in fails for t in texts):
                time.sleep(4)  # other tasks end meanwhile
                raise OSError("killed")
            for t in texts:
                with open(f"{folder}/calls", "a") as out:
                    out.write(json.dumps(t) + "\n")
            return [[len(t), 1.0] for t in texts]

        return encode

    return make


def test_vectors_of_a_killed_run_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hooks, "TEXTS", 4)
    texts = spark.createDataFrame([(k, f"text {k % 30}") for k in range(60)] + [(90, None)], "id long, text string")
    path, calls = str(tmp_path / "v"), lambda: [json.loads(x) for x in (tmp_path / "calls").read_text().splitlines()]
    with pytest.raises(Exception, match="killed"):
        hooks.store_vectors(texts, counting_encoder(tmp_path, fails=("p text 7",)), path, prefix="p ")
    with pytest.raises(ValueError, match="no manifest"):
        hooks.read_vectors(spark, path)
    kept = {r.key for r in commits.logged(spark, f"{path}/vectors", hooks.T.StructType.fromDDL("key string, embedding array<float>")).collect()}
    assert kept
    got = hooks.store_vectors(texts, counting_encoder(tmp_path), path, prefix="p ")
    assert got.count() == 61 and {r.id: r.embedding[0] for r in got.collect()}[90] == 2.0
    assert sorted(set(calls())) == sorted({"p ", *(f"p text {k}" for k in range(30))})
    assert len(calls()) <= 31 + 4 * 8  # only what ran in tasks that were ended beside the killed one is repeated
    before = len(calls())
    hooks.store_vectors(texts, counting_encoder(tmp_path), path, prefix="p ")
    assert len(calls()) == before  # nothing is encoded a second time
    hooks.store_vectors(texts.limit(3), counting_encoder(tmp_path), path, prefix="q ")
    assert len(calls()) == before + 3 and hooks.read_vectors(spark, path).count() == 3


def test_vectors_of_unequal_lengths_are_refused(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    with pytest.raises(ValueError, match="lengths"):
        hooks.store_vectors(texts, lambda: lambda batch: [[0.0] * len(t) for t in batch], str(tmp_path / "v"))


def recording_judge(folder, busy):
    def make():
        def judge(prompt, seed):
            with open(f"{folder}/asked", "a") as out:
                out.write(f"{prompt}|{seed}\n")
            if busy and prompt.endswith(busy):
                raise OSError("busy")
            return f"{prompt} {seed}"

        return judge

    return make


def test_judging_asks_only_for_what_is_missing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hooks, "ASKED", 3)
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(10)] + [(3, "p3")], "item_id long, prompt string")
    log, asked = str(tmp_path / "log"), lambda: (tmp_path / "asked").read_text().splitlines()
    ask = lambda busy=None, rows=prompts, rubric="1": hooks.judge_durably(rows, recording_judge(tmp_path, busy), log, rubric=rubric, seeds=(0, 1), tasks=2, workers=3, retries=0)
    first = ask("7").collect()
    assert len(first) == 22 and {r.item_id for r in first if r.reply is None} == {7} and len(asked()) == 20
    second = ask().collect()
    assert len(asked()) == 22 and all(r.reply == f"p{r.item_id} {r.seed}" for r in second)
    assert {(r.item_id, r.calls) for r in second} == {(k, 2 if k == 7 else 1) for k in range(10)}
    ask()
    assert len(asked()) == 22
    ask(rubric="2"), ask(rows=spark.createDataFrame([(3, "other")], "item_id long, prompt string"))
    assert len(asked()) == 22 + 20 + 2


def plain_top(queries, vectors, k):
    out = []
    for q, x in queries:
        scores = sorted((-round(float(np.dot(x, v)), 12), i) for i, v in vectors if v is not None)
        out += [(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "block", "asked"), [(None, 16_384, 2048), (30, 16_384, 2048), (30, 7, 4), (1, 5, 2048)])
def test_pruned_search_is_exact_and_skips(spark, monkeypatch, cells, block, asked):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", asked)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 3
    vectors = [(i, (centres[i % 30] + rng.normal(size=8) * 0.05).tolist()) for i in range(600)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)] + [(5000, None)]  # a group of copies
    queries = [(q, (centres[q] + rng.normal(size=8)).tolist()) for q in range(10)] + [(77, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows, told = retrieval.CellIndex(df, cells=cells).top_k(spark.createDataFrame([*queries, (99, None)], "query_id long, query array<double>"), 6)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in rows.collect()) == plain_top(queries, vectors, 6)
    told = told.first()
    assert (told.n_queries, told.n_vectors) == (11, 660) and told.skipped == pytest.approx(1 - told.n_products / (11 * 660))
    assert told.skipped == 0 if cells == 1 else told.skipped > 0.5


def test_pruned_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    rows, told = retrieval.CellIndex(none).top_k(asked, 3)
    assert rows.count() == 0 and told.first().n_products == 0
    some = spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<double>")
    assert retrieval.CellIndex(some).top_k(asked.limit(0), 3)[0].count() == 0
    assert [tuple(r) for r in retrieval.CellIndex(some).top_k(asked, 3)[0].collect()] == [(1, 1, 1, 2.0)]


def test_shards_are_read_by_column(spark, tmp_path):
    for k in range(3):
        spark.range(5).select((F.col("id") + 5 * k).alias("id"), F.lit("x").alias("wide"), F.lit(k).alias("shard")).write.parquet(str(tmp_path / f"s{k}"))
    rows = files.read_shards(spark, [str(tmp_path / f"s{k}") for k in (0, 2)], ["id", "shard"])
    assert rows.columns == ["id", "shard"] and sorted(r.id for r in rows.collect()) == [*range(5), *range(10, 15)]
    assert "wide" not in rows._jdf.queryExecution().executedPlan().toString()


def test_waves_of_questions_read_their_own_files(spark, tmp_path, monkeypatch):
    """Every question is asked once, and no wave reads the questions of another."""
    read, asked = [], hooks._asked
    monkeypatch.setattr(hooks, "ASKED", 5)
    monkeypatch.setattr(hooks, "_asked", lambda rows, *args, **kw: read.append(set(rows.inputFiles())) or asked(rows, *args, **kw))
    prompts = spark.range(20).selectExpr("id as item_id", "concat('p', id) as prompt")
    got = hooks.judge_durably(prompts, lambda: lambda prompt, seed: f"{prompt} {seed}", f"file://{tmp_path}/log", rubric="1", tasks=2).collect()
    assert {(r["item_id"], r["seed"], r["reply"], r["calls"]) for r in got} == {(i, s, f"p{i} {s}", 1) for i in range(20) for s in range(3)}
    assert len(read) > 3 and len(set().union(*read)) == sum(map(len, read))
