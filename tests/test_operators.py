"""DataFrame operators: invariants and hand-computed cases."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from skein.functions import scores as sc
from skein.functions import text as tx
from skein.operators import clean, hooks, judging, report, retrieval, split, stats
from skein.plans import corpus, standins


def test_scores(spark):
    df = spark.createDataFrame([([-1.0, -0.5, -0.5, -2.0],), ([],), (None,)], "v array<double>")
    rows = df.select(sc.argmax(F.col("v")), sc.margin(F.col("v")), sc.softmax(F.col("v"))).collect()
    assert rows[0][0] == 1 and rows[0][1] == 0.0 and abs(sum(rows[0][2]) - 1) < 1e-12
    assert rows[1][2] == [] and rows[1][1] == 0.0 and rows[2][1] == 0.0
    arr = F.array(*map(F.lit, (1.0, 2.0, 2.0, 1.0)))
    got = spark.range(1).select(sc.first_mode(arr), sc.sample_sd(arr), sc.mean(arr)).first()
    assert got[0] == 1.0 and abs(got[1] - math.sqrt(1 / 3)) < 1e-12 and got[2] == 1.5


@pytest.mark.parametrize(("x", "p"), [(0.0, 1.0), (3.841458820694124, 0.05), (6.634896601021214, 0.01), (50.0, 1.5374597944280e-12)])
def test_chi2_tail(spark, x, p):
    assert spark.range(1).select(sc.chi2_tail(F.lit(x))).first()[0] == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize(("a", "b", "p"), [(117, 158, 0.0159), (97, 112, 0.3328), (121, 120, 1.0)])
def test_mcnemar_published(spark, a, b, p):
    counts = spark.createDataFrame([("x", "y", 1000, a, b, 0.0)], "arm_a string, arm_b string, n long, a_only long, b_only long, delta double")
    assert stats.mcnemar(counts).first()["p"] == pytest.approx(p, abs=6e-5)


def test_mcnemar_exact(spark):
    counts = spark.createDataFrame([("x", "y", 9, 1, 6, 0.0), ("x", "z", 9, 0, 0, 0.0)], "arm_a string, arm_b string, n long, a_only long, b_only long, delta double")
    rows = stats.mcnemar(counts).orderBy("arm_b").collect()
    assert rows[0]["p"] == pytest.approx(2 * (1 + 7) / 2**7) and rows[1]["p"] == 1.0 and rows[0]["method"] == "mcnemar-exact"


def test_costs(spark):
    row = spark.range(1).select(
        sc.crossover(F.lit(10.0), F.lit(0.001), F.lit(0.0), F.lit(0.006)), sc.crossover(F.lit(10.0), F.lit(0.1), F.lit(0.0), F.lit(0.1)),
        sc.detectable_effect(F.lit(1000)), sc.usd_per_query(sc.usd(F.lit(18214.27), 0.4), F.lit(0.0113 / 1000), F.lit(100)) * 1000,
    ).first()
    assert row[0] == 2000 and row[1] is None and row[2] == pytest.approx(0.06265, abs=1e-5) and row[3] == pytest.approx(20.249, abs=1e-3)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(sc.usd_per_query(F.lit(1.0), F.lit(1.0), F.col("id"))).collect()


def test_split_is_exact_and_order_free(spark):
    rows = [(i, f"s{i % 7}") for i in range(200)]
    made = []
    for parts in (1, 5):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "id long, subject string").repartition(parts)
        made.append(sorted(map(tuple, split.stratified_split(df, stratum="subject", test=50, val=20).select("id", "split").collect())))
    assert made[0] == made[1]
    names = [s for _, s in made[0]]
    assert (names.count("test"), names.count("val"), len(names)) == (50, 20, 200)


def test_manifest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, split string")
    told = split.id_digest(df, "split")
    assert split.verify_manifest(df, told).count() == 0
    assert [r["problem"] for r in split.verify_manifest(df.filter("id != 2"), told).collect()] == ["count"]
    twice = df.unionByName(spark.createDataFrame([(1, "b")], df.schema))
    assert [tuple(r) for r in split.shared_ids(twice).collect()] == [(1, ["a", "b"])]


def test_grouped_holdout(spark):
    rows = [(f"{p}-{k}", p * 10 + k, p, f"q {p} {k}", "a") for p in range(40) for k in range(3)] + [("dup", 999, 0, "Q  0 0", "A"), ("one", 998, 77, "alone", "x")]
    df = spark.createDataFrame(rows, "id string, pos long, passage long, question string, answer string")
    got = split.grouped_holdout(df, n_train=40, n_test=10).collect()
    train, test = [r for r in got if r["split"] == "train"], [r for r in got if r["split"] == "test"]
    assert len(train) == 40 and len(test) == 10
    assert {r["passage"] for r in test} <= {r["passage"] for r in train} and not {r["id"] for r in got} & {"dup", "one"}


def test_clean_questions_order_of_tests(spark):
    rows = [
        (1, 1, "hea?", "a", "b", "c", "d", 0, "single", None, "S"),
        (2, 2, "hea? ", "a", "b", "c", "d", 1, "multi", "x", None),
        (3, 3, "q", "None", "b", "c", "d", -1, "single", None, "S"),
        (4, 4, "q", "a", "b", "c", "d", -1, "single", None, "S"),
    ]
    names = "id long, pos long, question string, opa string, opb string, opc string, opd string, cop int, choice_type string, exp string, subject_name string"
    made = clean.clean_questions(spark.createDataFrame(rows, names), {"hea": "heart"})
    got = {r["id"]: r for r in made.collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["kept", "duplicate", "malformed", "unlabelled"]
    assert got[1]["question"] == "heart?" and got[2]["subject"] == "Unknown"
    report_ = clean.cleaning_report(made).first()
    assert (report_["rows_seen"], report_["rows_modified"], report_["tokens_repaired"]) == (4, 1, 2)


def test_numbered_and_corpus(spark):
    docs = spark.createDataFrame([(i, "A sentence of words. " * (i + 3)) for i in range(40)], "doc_id long, text string").repartition(7)
    got = retrieval.build_corpus(docs, prefix="p", size=300).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(len(got))) and [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert retrieval.build_corpus(docs, prefix="p", size=300, cap=5).count() == 5


def test_vectors_and_budget(spark):
    v = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = retrieval.top_k(q, v, 9).filter("rank = 1").collect()
    assert all(r["query_id"] == r["vec_id"] and r["score"] == 1.0 for r in top)
    assert retrieval.top_k(q, v, 9, least=0.5).count() == 4
    p = spark.createDataFrame([(1, i, "x" * 350) for i in range(1, 11)] + [(2, 1, "y" * 9000), (2, 2, "z")], "query_id long, rank int, text string")
    kept = retrieval.within_budget(p, 1100).groupBy("query_id").count().orderBy("query_id").collect()
    assert [r["count"] for r in kept] == [3, 1]


def test_numbered_sums_weights_in_order(spark):
    rows = [(i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, w long").repartition(6)
    got = sorted(map(tuple, retrieval.numbered(df, "w", "id", weight="w").select("id", "index", "before").collect()))
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = sorted((i, n, sum(x[1] for x in order[:n])) for n, (i, _) in enumerate(order))
    assert got == want
    assert retrieval.numbered(df.limit(0), "id").count() == 0


def test_products_of_a_block_stay_in_bounds():
    """A block of all its queries and vectors, a third of them equal: the peak is that of a strip."""
    rng = np.random.default_rng(5)
    queries, vectors = rng.normal(size=(retrieval.QUERY_BLOCK, 8)).round(1), rng.normal(size=(retrieval.VECTOR_BLOCK, 8)).round(1)
    vectors[::3] = vectors[0]
    ids, held = np.arange(len(vectors))[::-1].copy(), pa.array(list(vectors))
    tracemalloc.start()
    made = pa.Table.from_batches(retrieval._best(np.arange(len(queries)), queries, ids, held, 5))
    peak = tracemalloc.get_traced_memory()[1]
    cells = retrieval._nearest(vectors, vectors[1:900])[0]
    assert max(peak, tracemalloc.get_traced_memory()[1]) < 120e6
    tracemalloc.stop()
    for q in (0, 300, len(queries) - 1):
        scores = np.round(vectors @ queries[q], 12)
        want = sorted(zip(-scores, ids))[:5]
        assert [(-r["score"], r["vec_id"]) for r in made.filter(pa.compute.equal(made["query_id"], q)).to_pylist()] == want
    assert len(cells) == len(vectors)


def test_top_k_is_the_same_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(400)] + [(900 + i, [1.0] * 6) for i in range(9)] + [(999, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = []
    for i, x in rows:
        if i % 3 == 0 and x:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), k) for k, y in rows if y)[:4]
            want += [(i, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert sorted(map(tuple, retrieval.top_k(q, v, 4).collect())) == sorted(want)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 50)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 90)
    assert sorted(map(tuple, retrieval.top_k(q, v, 4).collect())) == sorted(want)
    assert retrieval.top_k(q.limit(0), v, 4).count() == retrieval.top_k(q, v.limit(0), 4).count() == 0


def test_gates_and_samples_refuse(spark):
    df = spark.createDataFrame([(1, "x"), (2, "all of the above"), (3, None), (4, "y")], "id long, gold string")
    assert split.refuse_held_out(df, df.filter("id > 9")).count() == 4
    with pytest.raises(ValueError, match="held-out items among the sources: 2"):
        split.refuse_held_out(df, df.filter("id = 2"))
    assert sorted(r["id"] for r in split.freetext_items(df, 2).collect()) == [1, 4]
    with pytest.raises(ValueError, match="3 items are asked for; 2"):
        split.freetext_items(df, 3)
    arms = spark.createDataFrame([("a", 1), ("b", 2)], "arm string, n int")
    assert report.known_arms(arms, ["b"], ["a", "b"]).count() == 1
    with pytest.raises(KeyError, match="unknown arms c; known are a, b"):
        report.known_arms(arms, ["c"], ["a", "b"])


def test_sheet_sample_fills_up(spark):
    df = spark.createDataFrame([(i, 0 if i < 2 else 1 + i % 2) for i in range(40)], "id long, grade int")
    got = sorted(map(tuple, split.sheet_sample(df, 12).collect()))
    assert len(got) == 12 and {g for _, g in got} == {0, 1, 2} and [i for i, g in got if g == 0] == [0, 1]
    assert [i for i, g in got if g == 1] == [2, 4, 6, 8, 10, 12] and [i for i, g in got if g == 2] == [3, 5, 7, 9]


def test_costs_of_missing_files_are_zero(spark):
    arms = spark.createDataFrame([("a", True, "x", 0.1), ("b", False, "none", None)], "arm string, uses_adapter boolean, corpus string, p50_s double")
    built = spark.createDataFrame([("x", 5.0)], "corpus string, embed_gpu_seconds double")
    none = spark.createDataFrame([], "train_gpu_seconds double")
    assert sorted(map(tuple, report.fixed_costs(arms, built, none).collect())) == [("a", 5.0, 0.1), ("b", 0.0, 0.0)]


def test_vector_store_checks_its_rows(spark, tmp_path):
    texts = spark.createDataFrame([(i, "t" * i) for i in range(20)], "id long, text string")
    encoder = lambda: lambda ts: [[len(t), 1.0] for t in ts]
    rows = hooks.store_vectors(texts, encoder, str(tmp_path / "v"))
    assert {r["id"]: r["embedding"][0] for r in rows.collect()} == {i: float(i) for i in range(20)}
    with pytest.raises(ValueError, match="no manifest"):
        hooks.read_vectors(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no texts"):
        hooks.store_vectors(texts.limit(0), encoder, str(tmp_path / "w"))


def test_http_judge_asks_again(spark):
    import http.server
    import json
    import threading

    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(asked)
            busy = len(seen) == 1
            said = json.dumps({"choices": [{"message": {"content": f"SCORE: {asked['seed'] % 3}"}}]}).encode()
            self.send_response(503 if busy else 200)
            self.end_headers()
            self.wfile.write(b"" if busy else said)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "item_id long, prompt string").coalesce(1)
    judge = hooks.http_judge(f"http://127.0.0.1:{server.server_port}/v1/", "m", system="s")
    got = sorted(map(tuple, hooks.judge_replies(prompts, judge, seeds=(0, 1), wait=0.01).collect()))
    server.shutdown()
    assert [g[:3] for g in got] == [(i, s, f"SCORE: {s}") for i in (1, 2) for s in (0, 1)] and sorted(g[3] for g in got) == [1, 1, 1, 2]
    assert seen[0]["messages"][0] == {"role": "system", "content": "s"} and seen[0]["model"] == "m"


def test_kappa(spark):
    cases = {(0, 0): 20, (0, 1): 5, (1, 0): 10, (1, 1): 15}
    rows = [k for k, n in cases.items() for _ in range(n)]
    got = stats.kappa(spark.createDataFrame(rows, "human int, machine int")).first()
    assert got["kappa"] == pytest.approx(0.4) and got["exact"] == 0.7
    same = stats.kappa(spark.createDataFrame([(2, 2)] * 5, "human int, machine int")).first()
    assert same["kappa"] == 0.0 and same["exact"] == 1.0


def test_resampling(spark):
    rows = [("a", i, float(i % 2)) for i in range(60)] + [("b", i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "arm string, id long, value double")
    one, two = (stats.bootstrap(df.repartition(n), resamples=100).orderBy("arm").collect() for n in (1, 6))
    assert one == two and one[0]["low"] < 0.5 < one[0]["high"] and one[1]["low"] == one[1]["high"] == 1.0
    diffs = spark.createDataFrame([("x", i, 0) for i in range(5)] + [("y", i, 1) for i in range(12)], "pair string, id long, d int")
    got = {r["pair"]: r["p"] for r in stats.sign_flips(diffs, rounds=200).collect()}
    assert got["x"] == 1.0 and got["y"] < 0.05


def test_resampling_is_as_fine_as_the_reference(spark, monkeypatch):
    import inspect

    from skein.plans import evaluation

    asked = {}
    for name in ("bootstrap", "sign_flips"):
        made = spark.createDataFrame([("a", 1, 0.5, 0.5, 0.5, 0.5)], "arm string, n long, mean double, low double, high double, p double")
        monkeypatch.setattr(stats, name, lambda df, name=name, made=made, **given: asked.setdefault(name, given) and made)
    evaluation.bootstrap_ci(spark, "/root/testdata/sf0.001")
    evaluation.signflip_test(spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    assert asked == {"bootstrap": {"resamples": 10_000}, "sign_flips": {"rounds": 20_000}}
    assert inspect.signature(stats.bootstrap).parameters["resamples"].default == 10_000
    diffs = spark.createDataFrame([("y", i, 1) for i in range(60)] + [("z", i, (-1) ** i * (1 + i % 3)) for i in range(9)], "pair string, id long, d int")
    got = {r["pair"]: r["p"] for r in stats.sign_flips(diffs).collect()}
    ds = [(-1) ** i * (1 + i % 3) for i in range(9)]
    flips = [sum(d if m >> i & 1 else -d for i, d in enumerate(ds)) for m in range(512)]
    assert got["y"] == 1 / 20_001 and got["z"] == pytest.approx(sum(abs(s) >= abs(sum(ds)) for s in flips) / 512, abs=0.02)
    ends = stats.bootstrap(spark.createDataFrame([("a", i, float(i % 2)) for i in range(100)], "arm string, id long, value double")).first()
    assert (ends["low"], ends["high"]) == pytest.approx((0.4, 0.6), abs=0.011)


def test_judging_and_errors(spark):
    replies = spark.createDataFrame([("a", 1, s, r) for s, r in enumerate(("SCORE: 2", "SCORE: 0", "?"))] + [("a", 2, 0, "?")], "arm string, question_id long, seed int, reply string")
    items = judging.item_grades(replies).orderBy("question_id").collect()
    assert items[0]["mean"] == 1.0 and items[0]["majority"] == 2 and items[0]["unparseable"] == 1 and items[1]["majority"] is None
    assert judging.strict_grades(judging.item_grades(replies)).count() == 1
    preds = spark.createDataFrame([("r", 1, "s", 0, 0, [0.0, -2.0]), ("r", 2, "s", 1, 0, [-0.1, 0.0]), ("r", 3, "s", None, 0, None)], "arm string, question_id long, subject string, predicted_idx int, answer_idx int, option_logs array<double>")
    got = {r["question_id"]: r["category"] for r in report.collect_errors(preds).collect()}
    assert got == {2: "near_miss"}
    ref = spark.createDataFrame([(1, False), (2, True)], "question_id long, ok boolean")
    got = {r["question_id"]: r["category"] for r in report.collect_errors(preds, ref).collect()}
    assert got == {1: "fixed_by_retrieval", 2: "broken_by_retrieval"}


def test_jobs_and_runs(spark):
    jobs = spark.createDataFrame([("a", 1, "g", 1.0, "done"), ("b", 2, "h", 2.0, "open")], "name string, pos int, grp string, hours double, status string")
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "zz")], "name string, dep string")
    got = {(r["name"], r["dep"]): r["problem"] for r in report.job_problems(jobs, deps).collect()}
    assert got == {("a", "b"): "later", ("b", "a"): "group", ("b", "zz"): "unknown"}
    paths = spark.createDataFrame([("r", "checkpoint-9"), ("r", "checkpoint-10")], "run string, path string")
    assert report.latest_checkpoint(paths).first()["path"] == "checkpoint-10"
    runs = spark.createDataFrame([("x", 1), ("x", 2)], "arm string, seed int")
    with pytest.raises(Exception, match="no reference run"):
        stats.reference_run(runs).collect()


def test_repair_proposals(spark):
    counts = spark.createDataFrame([("aery", 30), ("artery", 40), ("pas", 50), ("parts", 50), ("ab", 99), ("artb", 1)], "word string, n long")
    words = spark.createDataFrame([("artery",), ("parts",), ("artb",)], "word string")
    got = {r["token"]: r["repair"] for r in clean.propose_repairs(counts, words).collect()}
    assert got == {"aery": "artery"}
    assert {r["token"] for r in clean.build_lexicon(counts, words).collect()} == set(clean.OVERRIDES)


def test_repairs_by_lexicons_of_any_size(spark, monkeypatch):
    """A small lexicon, a large one and a joined one repair alike; the planner makes a constant of the first two."""
    few = {f"w{i}": f"Fixed{i}é" for i in range(225)} | {"it's": "no", "é": "e", 'q"': "never"}
    many = few | {f"x{i}": f"y{i}" for i in range(20_000)}
    texts = [None, "", "none", "W1 w2, W3! x_w4 w5's É é", "W10 W", "plain text only", "w224\nw225 X19", "it's"] * 2
    df = spark.createDataFrame([(i % 9 or None, t, t) for i, t in enumerate(texts)], "id long, a string, b string")

    def plain(text, lexicon):
        if text is None:
            return None, None
        pieces = re.findall(r"\w+|\W+", text)
        made = [lexicon.get(w.lower()) for w in pieces]
        cased = [w if f is None else f.upper() if w.isupper() and len(w) > 1 else f[0].upper() + f[1:] if w[0] != w[0].lower() else f for w, f in zip(pieces, made, strict=True)]
        return "".join(cased), sum(f is not None for f in made)

    for lexicon in (few, many):
        table = spark.createDataFrame([*lexicon.items(), ("w1", "zzz"), (None, "x"), ("x", None)], "token string, repair string")
        for most in (50_000, 10):
            monkeypatch.setattr(clean, "CONSTANT", most)
            made = clean.repair_rows(df, ["a", "b"], table)
            got = [(tuple(r.a_told or (None, None)), r.a_told == r.b_told) for r in made.collect()]
            assert sorted(map(str, got)) == sorted(str((plain(t, lexicon), True)) for t in texts)
        told = df.select(tx.repair_counted(F.col("a"), lexicon).alias("t"), tx.repair(F.col("a"), lexicon).alias("r")).collect()
        assert [(tuple(r.t) if r.t else (None, None)) for r in told] == [plain(t, lexicon) for t in texts] and all(r.r == (r.t and r.t.text) for r in told)
    plan = df.select(tx.repair(F.col("a"), few).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "jsontostructs" not in plan.lower()


def test_repair_proposals_of_several_pairs(spark):
    rows = [("aery", 30), ("artery", 40), ("paent", 25), ("patient", 90), ("col", 44), ("cold", 9), ("mlar", 30), ("molar", 1), ("xx", 99)]
    counts = spark.createDataFrame(rows, "word string, n long")
    words = spark.createDataFrame([(w,) for w in ("artery", "patient", "cold", "molar", "coal", "collar")], "word string")
    got = {r.token: (r.repair, r.pair, r.n_correct) for r in clean.propose_repairs(counts, words, pairs=("rt", "ti", "ol", "id")).collect()}
    assert got == {"aery": ("artery", "rt", 40), "paent": ("patient", "ti", 90)}


def test_repair_proposals_as_tried_one_by_one(spark):
    """All pairs are tried in one pass over the tokens."""
    rng, pairs = random.Random(5), ("ab", "ba", "aa", "bc")
    seen = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 60) for _ in range(900)}
    known = {w for w in seen if rng.random() < 0.15}
    want = {}
    for token, n in seen.items():
        if n >= 20 and len(token) >= 2 and token not in known:
            made = [(p, token[:i] + p + token[i:]) for p in pairs for i in range(1, len(token) + 1)]
            made = [(p, w) for p, w in made if w in known]
            if len({w for _, w in made}) == 1 and seen[made[0][1]] >= 0.3 * n:
                want[token] = (made[0][1], made[0][0], n, seen[made[0][1]])
    counts = spark.createDataFrame(list(seen.items()), "word string, n long")
    found = clean.propose_repairs(counts, counts.filter(F.col("word").isin(*known)).select("word"), pairs=pairs)
    assert len(want) > 5 and {r.token: (r.repair, r.pair, r.n, r.n_correct) for r in found.collect()} == want
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_mining_counts_the_words_of_the_texts_once(spark):
    """What both queries read, again and again, are stored counts."""
    counts, dictionary = corpus._mined(spark, "/root/testdata/sf0.001")
    for rows in (counts, dictionary, clean.build_lexicon(counts, dictionary, pairs=corpus.DROPPED_PAIRS)):
        assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count() > 1000


def test_cyclic_control(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    assert [r["control"] for r in stats.cyclic_next(df, "t", "id").orderBy("id").collect()] == ["b", "c", "a"]


def test_hooks(spark):
    def make():
        calls = {}

        def judge(prompt, seed):
            calls[prompt, seed] = calls.get((prompt, seed), 0) + 1
            if prompt == "bad" or calls[prompt, seed] < 2:
                raise OSError("busy")
            return f"SCORE: {seed}"

        return judge

    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "item_id long, prompt string")
    got = {(r["item_id"], r["seed"]): (r["reply"], r["tries"]) for r in hooks.judge_replies(prompts, make, seeds=(0, 1), retries=2, wait=0.0).collect()}
    assert got == {(1, 0): ("SCORE: 0", 2), (1, 1): ("SCORE: 1", 2), (2, 0): (None, 3), (2, 1): (None, 3)}
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, text string")
    vectors = hooks.embed(texts, lambda: lambda batch: [[len(t), 1.0] for t in batch], prefix="q: ")
    assert {r["id"]: r["embedding"] for r in vectors.collect()} == {1: [5.0, 1.0], 2: [4.0, 1.0]}


def test_unfit_questions_of_one_hash_are_in_no_window_together(spark):
    """Blank rows all have one hash; their window is by row, and what becomes of rows is as before."""
    rows = [(i, i, "", "", "", "", "", 0, "single", None, None) for i in range(40)] + [(90 + i, 9 - i, "q", "a", "b", "c", "d", -1 if i == 9 else 1, "multi", "none", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, pos long, question string, opa string, opb string, opc string, opd string, cop int, choice_type string, exp string, subject_name string")
    made = clean.clean_questions(df)
    got = {r["id"]: r["status"] for r in made.collect()}
    assert got == dict.fromkeys(range(40), "malformed") | dict.fromkeys(range(90, 98), "duplicate") | {98: "kept", 99: "unlabelled"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(hash#\d+, _w", plan) or "hash#" in plan and "CASE WHEN isnotnull(status" in plan
    assert clean.checked_questions(df).filter("status is null").groupBy("hash").count().count() == 1


def test_options_come_from_the_first_seven_words(spark, tmp_path):
    texts = [None, "", "  ", "a", "a b\tc\nd e f g h i", "\x0ba\x0c b\r\nc d\u00a0e f  g", "x" * 50_000 + " y", " a b c d e f g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: (r["opa"], r["opb"], r["opc"], r["opd"]) for r in standins.questions(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^ \t\n\r\f\x0b]+", t or "") + [""] * 7
        assert got[i] == tuple(words[k] for k in (0, 2, 4, 6))


def test_a_joined_lexicon_repairs_as_a_constant_one(spark, monkeypatch):
    texts = ["Hea hea HEA, xhea hea", "", None, "no entry", "Émile hea\n\u212aelvin kelvin", "aery " * 3000]
    rows = spark.createDataFrame([*enumerate(texts), (None, "hea"), (0, "Aery")], "id long, text string")
    lexicon = spark.createDataFrame([("hea", "heart"), ("aery", "artery"), ("kelvin", "kerlvin"), ("émile", "x"), ("hea", "zzz")], "token string, repair string")
    told = lambda df: sorted(map(str, df.select("id", "text", "text_told.*").collect()))
    want = told(clean.repair_rows(rows, ["text"], lexicon))
    monkeypatch.setattr(clean, "CONSTANT", 1)
    joined = clean.repair_rows(rows, ["text"], lexicon)
    assert told(joined) == want
    plan = joined._jdf.queryExecution().toString()
    assert "element_at" not in plan  # a map is searched entry by entry
