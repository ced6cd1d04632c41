"""Chat formatting, quality rules, personal data and exact duplicates."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from skein.llm import chat, dedup, pii, quality
from skein.sources import scratch

EVENTS = "conv_id long, seq long, turn long, op string, role string, text string"


def formatted(spark, rows, extra=False):
    df = spark.createDataFrame(rows, EVENTS)
    if extra:
        df = df.withColumns({"piece": F.lit("x"), "pos": F.lit(9), "formatted": F.lit("y")})
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("read"))
    return {r["conv_id"]: r for r in out.collect()}


def test_chat_folds_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"),
        (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "Good "), (1, 6, 1, "delta", None, "day"),
        (1, 7, 0, "edit", None, "hello?"), (1, 8, 1, "message", "assistant", "second"), (2, 1, 0, "delta", "user", "alone"),
        (3, 1, 0, None, None, None),
    ]
    random.Random(1).shuffle(rows)
    got = formatted(spark, rows, extra=True)
    said = [(m["role"], m["text"]) for m in got[1]["read"]]
    assert said == [("user", "hello?"), ("assistant", "Good day"), ("assistant", "second")]
    assert [(m["role"], m["text"]) for m in got[2]["read"]] == [("user", "alone")]
    assert [(m["role"], m["text"]) for m in got[3]["read"]] == [("", "")] and got[1]["n_turns"] == 3


def test_chat_escapes_reversibly_and_masks(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "a<\\\\|b|>", "\n\n", "", "日本 <|", "<<|<\\|", "\\n\\\\n"]
    rows = [(i, 0, 0, "message", "as\\n\nsist<|", t) for i, t in enumerate(odd)]
    rows += [(i, 1, 1, "message", "assistant", t) for i, t in enumerate(odd)] + [(i, 2, 2, "message", "user", None) for i in range(len(odd))]
    got = formatted(spark, rows)
    plain = lambda t: re.sub(r"<(\\*)\\\|", r"<\1|", t)
    for i, text in enumerate(odd):
        assert [(m["role"], m["text"]) for m in got[i]["read"]] == [("as\\n\nsist<|", text), ("assistant", text), ("user", "")]
        (span,) = got[i]["loss_spans"]
        assert plain(got[i]["formatted"][span["start"] : span["start"] + span["chars"]]) == text
        assert got[i]["formatted"].count(chat.OPEN) == got[i]["formatted"].count(chat.CLOSE) == 3


def test_chat_mask_cuts_the_rendering(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "é𝄞 日本 <|", "", "x\ny" * 50_000]
    rows = [(1, 2 * i, 2 * i, "message", "user", "not " + t) for i, t in enumerate(texts)]
    rows += [(1, 2 * i + 1, 2 * i + 1, "message", "assistant", t) for i, t in enumerate(texts)] + [(2, 0, 0, "message", "user", "none")]
    made = chat.format_chats(spark.createDataFrame(rows, EVENTS))
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["chars"].alias("chars")))
    mask = lambda spans: chat.masked_text(F.col("formatted"), spans)
    got = {r["conv_id"]: r for r in made.select("conv_id", mask(F.col("loss_spans")).alias("right"), mask(moved).alias("wrong")).collect()}
    assert got[1]["right"] == "".join(texts) != got[1]["wrong"] and got[2]["right"] == ""


def test_chat_roles_are_reversible(spark):
    odd = ["a\x00b", "\\\\n\\n\n", "\x00", "\\", "\\x00n", "<\\\\|\\", "n\\\n\\"]
    df = spark.createDataFrame([(r,) for r in odd], "role string")
    assert [r[0] for r in df.select(chat.unescape_role(chat.escape_role(F.col("role")))).collect()] == odd


def test_chat_ties_empty_table_and_unknown_op(spark):
    rows = [(1, 0, 0, "message", "user", "b"), (1, 0, 0, "message", "user", "a"), (1, 0, 0, "message", "user", "a")]
    assert [m["text"] for m in formatted(spark, rows)[1]["read"]] == ["a", "a", "b"]
    assert formatted(spark, []) == {}
    with pytest.raises(Exception, match="unknown op"):
        formatted(spark, [(1, 0, 0, "shout", "user", "b")])


def plain_measures(text):
    ws = [w for w in re.split("[\t-\r ]+", text or "") if w]
    windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search("[^\t-\r ]", x)]
    return (len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_match_plain_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 7, "a " * 8, "a " * 9, "x y z " * 30, "l\nl\n \nl", "#*$ %&|<> é\x85\xa0b"]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in (20, 60, 300)]
    texts += ["\n".join(" ".join(str(rng.randrange(4)) for _ in range(6)) for _ in range(40)), "w" * 50_000, "q r s t u v w x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit("clash"))
    got = quality.measured(df, prefix="p_").orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[f"p_{n}"] for n in names) for r in got] == [plain_measures(t) for t in texts]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.02), (3, 400, 0.02), (10, 2000, 0.01), (0, 5, 0.5), (180, 10_000, 0.02)])
def test_binomial_tail(spark, k, n, p):
    q = Fraction(p)
    want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
    assert spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0] == pytest.approx(want, rel=1e-9)


def quality_tables(spark, n=1800):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        ws = rng.sample(words, 60)
        bad = i % 6 == 0
        docs.append((i, "en" if i % 2 else "de", " ".join(w + "###" if bad else w for w in ws)))
        labels.append((i, int(not bad)))
    docs += [(n, "xx", " ".join(w + "###" for w in words[:50])), (n + 1, None, None), (n + 2, "en", ""), (n + 2, "en", "")]
    return spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_rules_reject_bad_and_keep_clean(spark):
    docs, labels = quality_tables(spark)
    docs = docs.withColumns({"stratum": F.lit(1), "cutoffs": F.lit(2), "kept": F.lit(3)})
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i]["kept"] == (i % 6 != 0) for i in range(1800))
    assert got[1800]["kept"] and not got[1801]["kept"] and not got[1802]["kept"]  # no labels of xx; empty texts fail
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_quality_cutoffs_need_enough_labels(spark):
    docs, labels = quality_tables(spark)
    assert quality.certified_cutoffs(quality.measured(docs), labels.limit(40)).count() == 0
    found = quality.certified_cutoffs(quality.measured(docs), labels).collect()
    assert {r["rule"] for r in found} == set(quality.RULES) and all(r["above_good"] < 0.02 * r["n_good"] for r in found)
    assert quality.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def random_measures(spark, strata, n, seed):
    """Measures with noisy rules that overlap, so that five bounds of their own would not do."""
    rng = random.Random(seed)
    rows = []
    for i in range(strata * n):
        bad = rng.random() < 0.2
        share = lambda lift: min(1.0, max(0.0, rng.gauss(0.05 + lift * bad, 0.03)))  # noqa: B023, E731
        counts = [round(1000 * share(lift)) for lift in (0.1, 0.05, 0.2, 0.02, 0.1)]
        rows.append((i, f"s{i % strata}", False, 1000, 1000, 1000, *counts, int(not bad)))
    names = "doc_id long, lang string, base_failed boolean, word_chars long, n_words long, n_lines long, n_symbols long, n_bangs long, n_upper long, n_repeat_words long, n_dup_lines long, quality int"
    return spark.createDataFrame(rows, names), rows


def test_quality_cutoffs_match_plain_tests(spark):
    df, rows = random_measures(spark, 3, 1500, 2)
    half = {r["doc_id"]: r["t"] for r in df.select("doc_id", quality.tuning_half(F.col("doc_id")).alias("t")).collect()}
    got = {(r["stratum"], r["rule"]): (round(100 * r["cutoff"]), r["n_good"], r["above_good"]) for r in quality.certified_cutoffs(df, df.select("doc_id", "quality")).collect()}
    cell = lambda x: min(100, -(-x // 10))
    want = {}
    for s in ("s0", "s1", "s2"):
        own = [(half[r[0]], r[11], [cell(x) for x in r[6:11]]) for r in rows if r[1] == s]
        gain = lambda goods, bads, over: sum(map(over, bads)) / max(1, len(bads)) - 25 * sum(map(over, goods)) / max(1, len(goods))
        split = lambda tuning: ([c for t, q, c in own if t == tuning and q], [c for t, q, c in own if t == tuning and not q])  # noqa: B023, E731
        goods, bads = split(True)
        aims = [max(range(101), key=lambda cut, k=k: (round(gain(goods, bads, lambda c: c[k] > cut), 12), cut)) for k in range(5)]  # noqa: B023
        goods, bads = split(False)
        best = None
        for step in range(100, -1, -1):
            cuts = [a + step * (100 - a) // 100 for a in aims]
            over = lambda c: any(x > y for x, y in zip(c, cuts, strict=True))  # noqa: B023, E731
            k, n, q = sum(map(over, goods)), len(goods), Fraction(1, 50)
            if k >= n * q or sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)) > Fraction(5, 300):
                break
            best = max(best or (-9, 0), (round(gain(goods, bads, over), 12), step, cuts, k))
        for rule, cut in zip(("symbols", "bangs", "upper", "repeats", "dup_lines"), best[2], strict=True):
            want[s, rule] = (cut, len(goods), best[3])
    assert got == want


def test_quality_rules_bound_the_joint_false_rejection(spark):
    df, rows = random_measures(spark, 12, 2500, 3)
    labelled = df.filter("doc_id < 20000").select("doc_id", "quality")
    cuts = {}
    for r in quality.certified_cutoffs(df, labelled).collect():
        cuts.setdefault(r["stratum"], {})[r["rule"]] = round(100 * r["cutoff"])
    order = ("symbols", "bangs", "upper", "repeats", "dup_lines")
    for s, own in cuts.items():
        goods = [r[6:11] for r in rows if r[1] == s and r[11]]
        wrong = sum(any(-(-x // 10) > own[rule] for rule, x in zip(order, r, strict=True)) for r in goods)
        assert wrong < 0.02 * len(goods), s
    assert len(cuts) == 12 and any(c < 100 for own in cuts.values() for c in own.values())


def base_pii(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    plain = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    found = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(plain) for m in re.finditer(p, text or "") if good[k](m.group(0)))
    return ",".join(f"{plain[n][0]}:{a}:{b}" for a, n, b in found)


def test_pii_base_matches_plain_patterns(spark):
    texts = [
        None, "", "a.b+c@x-y.co.uk, z@q.io_t@w.de @@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0010.1.1.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (706) 555-3138 +49 30 1234 +1 2", "é𝄞 mail ü@x.com me@x.com 9.9.9.9", "7" * 40_000, "a" * 60_000 + "@", "1." * 20_000, "+1" + " " * 5000 + "2",
        "x@y.z " * 2000, "4" * 16 + " " + "0" * 12,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row": F.lit(1), "email": F.lit("e"), "like": F.lit("l")})
    got = {r["doc_id"]: r["b"] for r in pii.find_private(df).select("doc_id", pii.told(F.col("base")).alias("b")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_pii(t) for t in texts]


def test_pii_contexts_find_unknown_identifiers(spark):
    docs = [(i, f"Some words here. Reach me at user{i}@mail.com soon.") for i in range(12)]
    docs += [(50, "Again reach me at AB-9921-77X now."), (51, "Order of size 123456789 was made 20240101."), (52, "Reach me at noon.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_private(df).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()}
    text = docs[12][1]
    at = text.index("AB-")
    assert got[50] == f"id:{at}:{at + len('AB-9921-77X')}" and got[51] == "" and got[52] == "" and got[0].startswith("email:")
    assert pii.find_private(df.limit(0)).count() == 0


def test_pii_contexts_without_base_seeds(spark):
    import hashlib

    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    docs = [(i, f'word{chr(97 + i)} some token = "{secret(i)}" other') for i in range(12)]
    docs += [(20 + i, f"{chr(97 + i)}x password: {secret(620 + i)} {chr(97 + i)}y") for i in range(8)]
    docs += [(40, "my password: 77-1234-x end"), (41, f"Seen {secret(200)} once, the 4556737586899851 of the day 20240101.")]
    docs += [(50 + i, f"Is the day, is the night, is the {secret(300 + i)} of the day of noon of all.") for i in range(6)]
    docs += [(60 + i, f"{secret(400 + i)} was{i} approved-by-staff") for i in range(3)] + [(70 + i, f"x{chr(97 + i)} {secret(500 + i)} expires soon") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_private(df).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()}
    for i, text in docs:
        if i < 40 or i >= 70:
            at = text.index(next(w.strip('"') for w in text.split() if len(w.strip('"')) == 40))
            assert got[i] == f"id:{at}:{at + 40}", text
        elif i == 40:
            assert got[i] == "id:13:22"
        else:
            assert got[i] == "", text


def test_pii_contexts_of_base_seeds_alone(spark):
    """Without strings coded by their form as seeds, contexts that e-mails stand in carry finds."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    fill = lambda: " ".join(word() for _ in range(8))
    texts = [f"{fill()}. Contact: user{k}@mail.com {fill()}" for k in range(40)]
    texts += [f"{fill()} Contact: Q{chr(65 + k)}X{k}Z77 {fill()}" for k in range(5)] + [f"{fill()} run{k}x {fill()}" for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for coded in (False, True):
        got = {r["doc_id"]: r["s"] for r in pii.find_private(df, coded=coded).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()}
        assert [i for i, s in got.items() if "id:" in s] == list(range(40, 45))
        assert all(s.startswith("email:") for i, s in got.items() if i < 40)


def test_pii_candidates_are_whole_runs(spark):
    texts = ["x" * 300 + "12", "-_ab-12/c3_. abcdef,12345 a1b2", "a-" * 30_000 + "b", "no digits here", "12345", "é12345é --a1234--", ("ab1" * 20_000) + "."]
    want = [["x" * 300 + "12"], ["ab-12/c3", "12345"], [], [], ["12345"], ["12345", "a1234"], ["ab1" * 20_000]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", "t", pii.like_spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [[m.match for m in r.s] for r in got] == want
    assert all(r.t[m.start : m.end] == m.match for r in got for m in r.s)


def test_pii_graph_scores_match_a_plain_walk(spark):
    rng = random.Random(21)
    told = {f"i{k}": rng.random() < 0.4 for k in range(120)}
    edges = {(f"p{rng.randrange(25)}", i) for i in told for _ in range(rng.randrange(1, 5))}
    edges |= {("good", f"i{k}") for k in range(120) if told[f"i{k}"]} | {("good", f"n{k}") for k in range(3)} | {("next", f"n{k}") for k in range(3)} | {("next", f"i{k}") for k in range(120) if told[f"i{k}"]}
    told |= {f"n{k}": False for k in range(3)}
    score = {i: float(t) for i, t in told.items()}
    for turn in range(3):
        trusted = {}
        for p in {p for p, _ in edges}:
            own = [score[i] for q, i in edges if q == p]
            confidence, support = sum(own) / (len(own) + 1), sum(x > 0 for x in own)
            if support >= 5 and confidence >= 0.6:
                trusted[p] = (round(confidence, 9), support)
        if turn < 2:
            score = {i: 1.0 if t else max(trusted.get(p, (0.0, 0))[0] for p, j in edges if j == i) for i, t in told.items()}
    rows = [(p, i, told[i]) for p, i in edges] * 2
    got = pii.score_patterns(spark.createDataFrame(rows, "pattern string, instance string, told boolean"), trust=0.6)
    assert {r["pattern"]: (round(r["confidence"], 9), r["support"]) for r in got.collect()} == trusted and {"good", "next"} <= set(trusted)


def test_pii_long_and_few_digit_identifiers(spark):
    far = "w" * 90
    docs = [(i, f"Reach me at user{i}@mail.com soon.") for i in range(12)] + [(20, "Reach me at " + "0f" * 32 + " now"), (21, "Reach me at AB-9-XYZ now")]
    docs += [(30 + i, f"{far} {far}x 10.0.0.{i} {i}") for i in range(12)] + [(50, f"{far} {far}x KL-7-MNO end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_private(df).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()}
    assert got[20] == "id:12:76" and got[21] == "id:12:20" and got[50] == "id:183:191"


def test_dedup_groups_texts(spark):
    rows = [(5, "a"), (3, "a"), (9, None), (1, ""), (None, "a"), (7, "b"), (7, "b"), (None, "n"), (2, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "keep_id": F.lit(2), "t": F.lit(3)})
    for keep, best in (("min", min), ("max", max)):
        got = sorted(map(tuple, dedup.exact_duplicates(df, keep=keep).collect()), key=str)
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        want = []
        for t, ids in groups.items():
            stays = best((i for i in ids if i is not None), default=None)
            want += [(i, stays, len(ids), stays is None or i == stays, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        assert got == sorted(want, key=str)
    kept = dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "n"), (1, ""), (2, "A"), (3, "a"), (7, "b")]
    assert dedup.exact_duplicates(df.limit(0)).count() == 0


def test_dedup_survives_hash_collisions(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda t: F.unhex(F.left(F.md5(t), F.lit(1)))
    want = sorted(map(tuple, dedup.exact_duplicates(df).collect()))
    for hashed in (weak, lambda t: F.unhex(F.lit("00"))):
        assert sorted(map(tuple, dedup.exact_duplicates(df, hashed=hashed).collect())) == want


def test_native_plans_run_no_python(spark, monkeypatch):
    """Neither the plan of a result nor that of any table that is stored on the way has Python in it."""
    docs, labels = quality_tables(spark, 60)
    events = spark.createDataFrame([(1, 1, 0, "message", "user", "hi")], EVENTS)
    names = []

    def checked(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
        names.append(name)
        return scratch.store(df, name)

    for module in (chat, dedup, pii, quality):
        if hasattr(module, "store"):
            monkeypatch.setattr(module, "store", checked)
    for df in (quality.quality_rules(docs, labels), pii.find_private(docs), dedup.exact_duplicates(docs), chat.format_chats(events)):
        checked(df, "result")
    checked(dedup.drop_exact_duplicates(docs), "result")
    checked(quality.keep_good(docs, labels), "result")
    assert {"found", "edges", "scores", "patterns", "groups", "copies"} <= set(names)
