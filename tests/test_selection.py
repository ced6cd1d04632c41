"""Order statistics, splits, the bootstrap and the report rows made of them, against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import report, selection, split, stats


@pytest.mark.parametrize("few", [1, 25, 10_000])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_order_statistics_are_those_of_a_sort(spark, kind, few, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 4)
    monkeypatch.setattr(selection, "SORTED", few)
    rng = random.Random(kind)
    draw = (lambda: rng.choice((7, 7, rng.randrange(-(2**59), 2**59), rng.randrange(50)))) if kind == "long" else (lambda: rng.choice((0.5, rng.gauss(0, 1), rng.expovariate(1e-6))))
    groups = {"a": [draw() for _ in range(300)], "b": [draw()], None: [draw() for _ in range(40)], "same": [draw()] * 30}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    ranks = [(g, r) for g, vs in groups.items() for r in {0, len(vs) // 3, len(vs) - 1, len(vs)}] + [("none", 0), ("gone", 0)]
    got = selection.order_statistics(spark.createDataFrame(rows, f"g string, v {kind}"), spark.createDataFrame(ranks, "g string, rank long"), by="g", value="v").collect()
    want = []
    for g, r in ranks:
        vs = sorted(groups.get(g, []))
        if r < len(vs):
            want.append((g, r, vs[r], sum(v < vs[r] for v in vs), vs.count(vs[r])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_percentiles_are_interpolated(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(0, 3, 1000), "b": rng.normal(size=2), "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for r in selection.percentiles(df, {"low": 0.025, "mid": 0.5, "high": 0.99}, by="g", value="v").collect():
        assert [r.low, r.mid, r.high] == pytest.approx(np.quantile(groups[r.g], [0.025, 0.5, 0.99]).tolist(), rel=1e-12) and r.n == len(groups[r.g])


def test_latencies_leave_out_the_first(spark):
    rows = [("a", k, 100.0 if k < 3 else float(k)) for k in range(50)] + [("b", k, 1.0) for k in range(3)]
    got = stats.latency_summary(spark.createDataFrame(rows, "arm string, seq long, seconds double").repartition(5)).collect()
    assert [(r.arm, r.n, r.p50, r.min, r.max) for r in got] == [("a", 47, 26.0, 3.0, 49.0)]
    plan = stats.latency_summary(spark.createDataFrame(rows, "arm string, seq long, seconds double"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_split_takes_the_first_of_each_stratum(spark, monkeypatch):
    rows = [(i, "all" if i % 10 else None) for i in range(400)] + [(7, "all")] * 30  # a repeated row ties with itself
    df = spark.createDataFrame(rows, "id long, subject string")
    want = []
    monkeypatch.setattr(selection, "SORTED", 10)
    shares = {r.subject: (r.n_test, r.n_test + r.n_val) for r in split.quotas(df, "subject", {"n_test": 90, "n_val": 33}).collect()}
    for name in ("all", None):
        own = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, s in rows if s == name)
        test, val = shares[name]
        want += [(i, name, "test" if k < test else "val" if k < val else "reserve") for k, (_, i) in enumerate(own)]
    made = split.stratified_split(df.repartition(6), stratum="subject", test=90, val=33)
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    everything = split.stratified_split(df, stratum="subject", test=400, val=30)
    assert {r["split"]: r["count"] for r in everything.groupBy("split").count().collect()} == {"test": 400, "val": 30}


def test_poisson_steps_cover_all_draws():
    for power in (0, 1, 6, 13):
        steps = stats.poisson_steps(power)
        assert steps[0][1] == 0 and steps[-1][2] == 2**32 and all(a[2] == b[1] for a, b in zip(steps, steps[1:], strict=False))
        share = [(high - low) / 2**32 for _, low, high in steps]
        mean = sum(k * p for (k, *_), p in zip(steps, share, strict=True))
        assert mean == pytest.approx(2**power, rel=1e-6)
        assert sum((k - mean) ** 2 * p for (k, *_), p in zip(steps, share, strict=True)) == pytest.approx(2**power, rel=1e-5)


def test_bootstrap_has_the_spread_of_the_mean(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = {"few": rng.integers(0, 3, 700) / 3, "many": rng.lognormal(0, 1, 150), "one": np.array([2.5])}
    df = spark.createDataFrame([(g, k, float(v)) for g, vs in values.items() for k, v in enumerate(vs)] + [("few", -1, None), ("null", 0, None)], "arm string, id long, value double")
    for power in (20, 3):  # numbers beyond the highest power are made of several draws
        monkeypatch.setattr(stats, "POWER", power)
        got = {r.arm: r for r in stats.bootstrap(df, resamples=2000).collect()}
        for g in ("few", "many"):
            plain = np.quantile([rng.choice(values[g], len(values[g])).mean() for _ in range(4000)], [0.025, 0.975])
            width = plain[1] - plain[0]
            assert abs(got[g].low - plain[0]) < 0.1 * width and abs(got[g].high - plain[1]) < 0.1 * width
            assert got[g].mean == pytest.approx(values[g].mean())
        assert (got["one"].low, got["one"].high, got["few"].n) == (2.5, 2.5, 701)
        assert got["null"].low is None and got["null"].n == 1


def test_paired_intervals(spark):
    rows = [("a", i, 1.0 if i % 3 else 0.5) for i in range(90)] + [("b", i, 0.5) for i in range(80)] + [("a", 200, 9.0)]
    diffs = stats.paired_differences(spark.createDataFrame(rows, "arm string, question_id long, s double"), [("a", "b"), ("b", "a")], value="s")
    got = {r.pair: r for r in stats.paired_intervals(diffs, resamples=1000, rounds=500, scale=2).collect()}
    one, two = got["a - b"], got["b - a"]
    d = [0.5 * bool(i % 3) for i in range(80)]
    assert (one.n, one.higher, one.lower, two.higher) == (80, 53, 0, 0) and one.delta == pytest.approx(sum(d) / 80) and two.delta == -one.delta
    assert one.low < one.delta < one.high and one.p == 1 / 501 and two.high < 0
    spread = 1.96 * np.std(d) / math.sqrt(80)
    assert one.high - one.low == pytest.approx(2 * spread, rel=0.15)


def test_report_rows(spark):
    arms = spark.createDataFrame([("x", 0.51234, 0.1, None, 40), ("y", 0.7, 0.2, 10, 40)], "arm string, graded double, judge_sd double, capped long, n long")
    ends = spark.createDataFrame([("x", 0.4, 0.6), ("y", 0.65, 0.755)], "arm string, low double, high double")
    known = spark.createDataFrame([("y", 0.568)], "arm string, accuracy double")
    got = [tuple(r) for r in report.freetext_rows(arms, ends, known, bound=256).orderBy("place").collect()]
    assert got == [(1, "y", "**0.700**", "[0.65, 0.76]", "0.200", "25% @256", "56.8%"), (2, "x", "0.512", "[0.40, 0.60]", "0.100", "—", "—")]
    deltas = spark.createDataFrame([("x", "y", 40, -0.02, -0.05, 0.01, 0.2), ("y", "x", 40, 0.11, 0.05, 0.17, 5e-5)], "arm_a string, arm_b string, n long, delta double, low double, high double, p double")
    wins = spark.createDataFrame([("y", "x", 7, 3, 0.25)], "arm_a string, arm_b string, a_wins long, b_wins long, position_bias_rate double")
    got = [tuple(r) for r in report.delta_rows(deltas, wins, known).orderBy("place").collect()]
    assert got == [
        (1, "y", "x", 40, "**+11.0**", "[+5.0, +17.0]", "5e-5", "—", "7-3 (25% flipped)"),
        (2, "x", "y", 40, "-2.0", "[-5.0, +1.0]", "0.200", "—", "—"),
    ]


def test_results_rows_and_runs_on_other_items(spark):
    kind = "arm string, headline boolean, exclusive boolean, accuracy double, low double, high double, n_seeds long, mean double, sd double, p50 double, p95 double, prompt_tokens double, hit_rate double, grounded_rate double"
    rows = [("base", True, True, 0.568, 0.538, 0.599, 1, 0.568, 0.0, 0.103, 0.118, 113.2, None, None), ("rag", False, False, 0.67, 0.641, 0.699, 3, 0.668, 0.004, 0.171, 0.193, 656.0, 0.57, 0.725)]
    df = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in report.results_rows(df).collect()] == [
        ("base", "56.8%", "[53.8, 59.9]", "—", "103 ms", "118 ms", "113", "—", "—"),
        ("rag ⚠", "67.0%", "[64.1, 69.9]", "66.8 ± 0.4 (n=3)", "171 ms", "193 ms", "656", "0.570", "0.725"),
    ]
    assert report.results_rows(df, headline_only=True).count() == 1
    preds = spark.range(50).select(F.col("id").alias("question_id"), F.lit(1).alias("seed"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"))
    assert report.same_items(preds) is preds
    with pytest.raises(ValueError, match="runs on different items"):
        report.same_items(preds.filter("arm = 'a' or question_id < 49"))
    with pytest.raises(ValueError, match="runs on different items"):
        report.same_items(preds.withColumn("question_id", F.col("question_id") + F.when(F.col("arm") == "b", 1).otherwise(0)))


def test_tree_digests_tell_sets_of_ids(spark):
    ids = {"a": list(range(3000)), "b": list(range(1, 3001)), "c": list(range(3000))}
    rows = [(g, i) for g, own in ids.items() for i in own] + [("c", None)]
    made = {r.g: (r.n, r.digest) for r in split.tree_digest(spark.createDataFrame(rows, "g string, id long").repartition(7), "g").collect()}
    sha = lambda parts: hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()

    def plain(own):
        leaves, knots = {}, {}
        for i in map(str, own):
            leaves.setdefault(hashlib.md5(i.encode()).hexdigest()[:4], []).append(i)
        for leaf, parts in leaves.items():
            knots.setdefault(leaf[:2], []).append(leaf + sha(parts))
        return len(own), sha(knot + sha(parts) for knot, parts in knots.items())

    assert made == {g: plain(own) for g, own in ids.items()} and made["a"] == made["c"] != made["b"]


def test_payload_has_a_provenance(spark):
    arms = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "arm string, accuracy double")
    items = spark.createDataFrame([(10, 1), (9, 2)], "question_id long, answer_idx int")
    got = report.payload(arms, arms.limit(0), items, seed=7, git="abc").first()
    assert [a.arm for a in got.arms] == ["a", "b"] and got.costs == [] and [i.question_id for i in got["items"]] == [9, 10]
    assert got.provenance.asDict() == {"split_sha256": hashlib.sha256(b"10\n9").hexdigest(), "n_items": 2, "seed": 7, "git": "abc", "device": None}


def test_answers_as_shown(spark):
    items = spark.createDataFrame([(1, ["w", "x", "y", "z"], 2)], "question_id long, options array<string>, answer_idx int")
    answers = spark.createDataFrame([("b", 1, 2, 0.756, 113), ("a", 1, None, None, None), ("z", 1, 0, 0.5, 9)], "arm string, question_id long, predicted_idx int, confidence double, prompt_tokens int")
    got = [tuple(r) for r in report.answer_rows(items, answers, ["a", "b"]).orderBy("place").collect()]
    assert got == [(1, 1, "a", "—", False, "wrong", "—", "—"), (1, 2, "b", "C. y", True, "correct", "76%", "113"), (1, 3, "z", "A. w", False, "wrong", "50%", "9")]
    stems = spark.createDataFrame([(1, " a\n b ", "s"), (2, "q" * 91, "t"), (3, "q" * 90, "t")], "question_id long, question string, subject string")
    assert {r.question_id: r.label for r in report.item_choices(stems).collect()} == {1: "[s] a b", 2: "[t] " + "q" * 87 + "…", 3: "[t] " + "q" * 90}
