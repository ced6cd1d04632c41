"""Text functions on hand-made vectors."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import prompts as pr
from skein.functions import text as tx


def values(spark, rows, kind, **columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    out = df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()
    return [tuple(r[k] for k in columns) if len(columns) > 1 else r[next(iter(columns))] for r in out]


def test_repair_keeps_case_and_whole_words(spark):
    texts = ["(hea) HEA Hea hea1 hea_x éhea", "aery", "", None]
    got = values(spark, texts, "string", t=tx.repair(F.col("x"), {"hea": "heart", "aery": "artery"}))
    assert got == ["(heart) HEART Heart hea1 hea_x éhea", "artery", "", None]


def test_lexicon_by_rule():
    assert tx.lexicon_by_loss(["artery", "heart", "bone"]) == {"aery": "artery", "hea": "heart"}


def test_blank_and_space(spark):
    got = values(spark, [" None ", None, " a  b ", "x"], "string", a=tx.blank_to_empty(F.col("x")), b=tx.norm(F.coalesce("x", F.lit(""))))
    assert got == [("", "none"), ("", ""), ("a  b", "a b"), ("x", "x")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ans. is 'c' i.e., Mite is the vector", "Mite is the vector"),
        ("Answer is A (Quinine) acts", "(Quinine) acts"),
        ("Ref - Vij pg 202", ""),
        ("The heart has four chambers", "The heart has four chambers"),
        ("B-cell lymphoma", "cell lymphoma"),
    ],
)
def test_answer_key(spark, text, want):
    assert values(spark, [text], "string", t=tx.strip_answer_key(F.col("x"))) == [want]


def test_option_dependent(spark):
    golds = ["All of the above", "B>A>D>C", "1, 2 and 3", "A. x B. y C. z", "neither a nor b", "option b is right", "3.1", "3-5%", "Both GH and prolactin"]
    got = values(spark, golds, "string", r=tx.option_dependent(F.col("x")))
    assert [g is None for g in got] == [False] * 6 + [True] * 3
    assert got[0] == "all/none of the above" and got[2] == "numbered-statement combination"


def test_chunks_on_worked_examples(spark):
    def cut(text, **limits):
        return values(spark, [text], "string", c=tx.chunks(F.col("x"), **limits))[0]

    text = "Aaaa  bbbb. Cccc\ndddd. Eeee. "
    assert cut(text, size=20, overlap=6, least=3) == ["Aaaa bbbb.", "bbbb. Cccc dddd.", "dddd. Eeee."]
    assert cut(text, size=20, overlap=5, least=3) == ["Aaaa bbbb.", "Cccc dddd. Eeee."]  # no space among the last five
    assert cut(text, size=20, overlap=6, least=12) == ["bbbb. Cccc dddd."]
    assert cut(text, size=27, overlap=6, least=27) == ["Aaaa bbbb. Cccc dddd. Eeee."]
    assert cut("x" * 25, size=10, overlap=4, least=1) == ["x" * 10, "x" * 19]
    assert cut("", least=1) == cut(" \n", least=1) == cut("short") == [] and cut("short", least=5) == ["short"]


def test_chunks_keep_every_sentence(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 9))) + rng.choice(".!?")
    unbroken = lambda n: "".join(rng.choice("abcdefg") for _ in range(n)) + "."
    texts = [[sentence() for _ in range(rng.randrange(1, 40))] for _ in range(60)] + [[unbroken(900)], ["a b.", unbroken(400), "c d."]]
    size, overlap = 100, 20
    got = values(spark, [" \n ".join(t) for t in texts], "string", c=tx.chunks(F.col("x"), size=size, overlap=overlap, least=1))
    for said, cut in zip(texts, got, strict=True):
        whole, end, last = " ".join(said), 0, -1
        for chunk in cut:
            at = whole.find(chunk, last + 1)
            assert last < at <= end + 1 and end - at <= overlap  # in order, no gap but a space, at most the overlap twice
            assert len(chunk) <= 2 * size
            last, end = at, at + len(chunk)
        assert end == len(whole)
        assert all(any(s in c for c in cut) for s in said if len(s) <= size)


def test_hash_ids_and_stems(spark):
    got = values(spark, ["a b c d e", "one"], "string", s=tx.split_stem(F.col("x")), p=tx.passage_id("p", F.col("x"), F.lit(7)))
    assert tuple(got[0][0]) == ("a b", "c d e") and tuple(got[1][0]) == ("one", "")
    assert got[0][1].startswith("p-00000007-") and len(got[0][1]) == 23
    h = tx.content_hash(F.col("x"), F.array(F.lit(" B "), F.lit("c")))
    a, b = values(spark, ["Stem ", "stem"], "string", h=h)
    assert a == b


def test_judge_replies(spark):
    got = values(spark, ["SCORE: 2", "score:1 because", "SCORE: 7", "none"], "string", s=tx.parse_score(F.col("x")))
    assert got == [2, 1, None, None]
    said = ["VERDICT: A", "verdict: Neither A nor B", "VERDICT: Answer B", "VERDICT: B.", "?"]
    assert values(spark, said, "string", v=tx.parse_verdict(F.col("x"))) == ["A", "TIE", None, "B", None]
    assert values(spark, ["A", "B", "TIE"], "string", v=tx.flip(F.col("x"))) == ["B", "A", "TIE"]


def test_names_options_and_formats(spark):
    stem = tx.run_stem(F.lit("rag"), F.lit(42))
    assert values(spark, ["x"], "string", s=stem, a=tx.run_arm(stem), n=tx.run_seed(stem)) == [("rag_seed42", "rag", 42)]
    assert values(spark, ["A. one\n\nB) two\nc: three\nfour\nfive"], "string", o=tx.parse_options(F.col("x"))) == [["one", "two", "three", "four"]]
    assert values(spark, [0.00001, 0.0005, 0.0321], "double", p=tx.p_value(F.col("x"))) == ["1.0e-05", "0.0005", "0.032"]
    assert values(spark, ["x" * 91], "string", t=F.length(tx.picker_label(F.col("x")))) == [88]
    assert values(spark, ["not  Medical\nadvice"], "string", t=tx.holds_phrases(F.col("x"), ["Not medical advice"])) == [True]
    reply = '{"choices":[{"message":{"content":"hi"}}]}'
    assert values(spark, [reply, "{}", "x"], "string", t=tx.extract_reply(F.col("x"))) == ["hi", None, None]


def test_prompts_round_trip(spark):
    options = F.array(F.lit("yes"), F.lit("no"))
    plain, full = pr.mcq_prompt(F.col("x"), options), pr.mcq_prompt(F.col("x"), options, F.array(F.lit(" one "), F.lit("two")))
    got = values(spark, [" What? "], "string", a=plain, b=pr.strip_context(full), c=full, d=pr.strip_context(plain))
    assert got[0][0] == got[0][1] == got[0][3] and "[2] two" in got[0][2] and "A. yes\nB. no" in got[0][0]
    empty = pr.freetext_prompt(F.col("x"), F.array().cast("array<string>"))
    assert values(spark, ["q"], "string", a=empty) == ["q\n\n" + pr.FREETEXT_INSTRUCTION]
    said = pr.judge_prompt("Q {question} R {reference} C {candidate}", question=F.col("x"), reference=F.lit("r"), candidate=F.lit("  "))
    assert values(spark, ["q"], "string", a=said) == ["Q q R r C " + pr.NO_ANSWER]


def test_decimals_are_rounded_by_the_exact_value(spark):
    ties = [0.00015, 0.00025, 0.00035, 0.00045, 0.0005, 0.125, 0.375, 2.5, 0.0, -0.0, -0.04, -0.25, 1e-300, 12345.65, 99.95, 99.949999, 4503599627370497.5, 0.5, 1.5]
    ties += [n / 1e4 for n in range(1, 2000, 7)] + [n / 1e6 for n in range(50, 1000, 50)]
    for digits in (0, 1, 3, 4):
        assert values(spark, ties, "double", p=tx.fixed(F.col("x"), digits)) == [f"{v:.{digits}f}" for v in ties]
    assert values(spark, [None, 0.00015, 0.2875], "double", p=tx.p_value(F.col("x")), q=tx.percent(F.col("x"))) == [(None, None), ("0.0001", "0.0%"), ("0.287", "28.7%")]


def test_strip_is_that_of_the_pattern(spark):
    """Every kind of white space, and what only looks like it, at both ends and inside."""
    kinds = [chr(c) for c in [*range(0, 33), 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    texts = ["", "a", "None", " nOnE ", "no ne", "\U0001d54f \U0001d54f"] + [f"{a}{b}x{a}y{b}{a}" for a in kinds for b in (" ", "\n", "")] + kinds
    plain = values(spark, texts, "string", a=F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))
    assert values(spark, texts, "string", a=tx.strip(F.col("x"))) == plain
    assert values(spark, texts, "string", a=tx.blank_to_empty(F.col("x"))) == ["" if t.lower() == "none" else t for t in plain]


def test_a_small_lexicon_repairs_as_any(spark, monkeypatch):
    """Words sought by a pattern, or every word looked up: one result, for odd letters and neighbours too."""
    lexicon = {"hea": "heart", "aery": "artery", "ask": "task", "kk": "kick"}
    parts = ["hea", "HEA", "Hea", "hEa", "a\u017fk", "as\u212a", "\u212a\u212a", "KK", "ask", "aery", "he\u0301a", "hea\u0301", "\u0130", "_", "1", "\u00e9", "\U0001d54f", "-", " ", "\n", ".", ""]
    rng = random.Random(8)
    texts = [None, "", *parts, *["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]]
    told = lambda: values(spark, texts, "string", t=tx.repair_counted(F.col("x"), lexicon), w=tx.repaired_words(F.col("x"), lexicon))
    assert hasattr(tx.lookup(lexicon), "pattern")
    quick = told()
    monkeypatch.setattr(tx, "SOUGHT", 0)
    assert not hasattr(tx.lookup(lexicon), "pattern")
    assert quick == told() and any(t and (t.n or 0) > 1 for t, _ in quick)
