"""Text functions as column expressions. All but ``repaired_with`` keep to built-ins, so they stay in the JVM."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: words of English too common to count as evidence.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will"
    " with which who whom this these those not no than then"
).split()

#: Labels of the options, and the separator of hashed parts.
LABELS = ("A", "B", "C", "D")
PART_MARK = "␟"

#: Patterns of answer-key openings and of bibliography-only texts.
QUOTE = "['\"‘’]?"
KEY_LEAD_IN = rf"(?iU)^\s*ans(?:wer)?\.?\s*(?:is)?\s*{QUOTE}[a-eA-E]{QUOTE}\s+(?=\()"
KEY_PREFIX = rf"(?iU)^\s*(?:ans(?:wer)?\.?\s*(?:is)?\s*)?[:\-]?\s*{QUOTE}[a-eA-E]{QUOTE}\s*(?:[.):,\-]|i\.?\s*e\.?)[,.\s]*"
REFERENCE_ONLY = r"(?iU)^\s*(?:ref(?:erence)?s?\b|see\s+ref)"

#: Rules by which a gold answer depends on options that aren't shown.
OPTION_LETTER = r"(?:[a-e]|i{1,3}|iv|vi{0,3})"
OPTION_RULES = (
    ("all/none of the above", r"(?i)\b(all|none)\b.{0,15}\b(above|of these)\b|^\s*(all|none)\s*$"),
    ("letter or ordering combination", rf"(?i)^\W*{OPTION_LETTER}(?:\s*(?:>|,|&|and|-)\s*{OPTION_LETTER})+\W*$"),
    ("numbered-statement combination", r"(?i)^\W*[1-9](?:\s*(?:,|&|and)\s*[1-9])+\W*$"),
    ("true/false grid", r"(?:\b[A-E][.)]\s*\S+\s*){3,}"),
    (
        "both/neither of the options",
        r"(?i)^\s*(both|neither)\s*(?:of\s+)?(?:the\s+)?(?:above|these)?\s*$"
        r"|^\s*(both|neither)\s+[a-e]\s*(?:and|&|,|nor|or)\s*[a-e]\b",
    ),
    ("option letters in prose", r"(?i)\boptions?\s+[a-e]\b|^\W*[a-e](?:\s*,\s*[a-e])+\s+(?:true|false|correct)"),
)


#: What ``(?U)\s`` matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim white space of any kind at both ends; texts without any there are left alone.

    A pattern would try its end at every space.
    """
    spaces = F.lit(SPACES)
    loose = lambda t: F.contains(spaces, F.left(t, F.lit(1))) | F.contains(spaces, F.right(t, F.lit(1)))
    return F.transform(F.array(text), lambda t: F.when(loose(t), F.btrim(t, spaces)).otherwise(t))[0]


def fold_space(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm(text: Column) -> Column:
    """Folded and in lower case, for comparing questions."""
    return F.lower(fold_space(text))


def normalise_phrase(text: Column) -> Column:
    """Runs of white space to a space and lower case, untrimmed, for seeking phrases."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_empty(text: Column) -> Column:
    """Null, and the word none in any case, become empty; other text is stripped."""
    stripped = F.array(strip(F.coalesce(text, F.lit(""))))
    return F.transform(stripped, lambda t: F.when((F.octet_length(t) == 4) & (F.lower(t) == "none"), "").otherwise(t))[0]


def alpha_words(text: Column) -> Column:
    """Words of letters a to z, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def alnum_words(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """The set of words longer than two characters that aren't stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(alnum_words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), F.lit(0))


#: Entries of a lexicon in one bucket of its table, on average, and entries up to which a text is sought for the
#: words of the lexicon instead of being cut into all its words.
BUCKET, SOUGHT = 4, 64


def _sought(words: Iterable[str]) -> str:
    """A pattern of whole words in any case: what has one of the words, of a to z, as its lower case.

    The Kelvin sign is the one character beyond ASCII whose lower case is a letter of a to z. A
    character of two code units in the pattern makes Java look back by whole characters.
    """
    cased = lambda c: "[kK\u212a]" if c == "k" else f"[{c}{c.upper()}]"
    words = sorted(words)
    first = "".join(sorted({cased(w[0])[1:-1] for w in words}))
    return rf"(?U)(?=[{first}])(?<![\w{chr(0x10FFFF)}])(?:{'|'.join(''.join(map(cased, w)) for w in words)})(?!\w)"


def lookup(lexicon: Mapping[str, str]) -> Callable[[Column], Column]:
    """A function from lower-case words to their repairs, or null.

    The lexicon becomes a constant hash table, an array of small maps by the CRC of the word. So a word
    costs the same whatever the lexicon's size; Spark's own maps are searched entry by entry.
    """
    n = max(1, len(lexicon) // BUCKET)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for token, repair_ in sorted(lexicon.items()):
        buckets[zlib.crc32(token.encode()) % n][token] = repair_
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")  # folded to a constant by the planner
    found = lambda word: F.try_element_at(F.get(table, (F.crc32(word.cast("binary")) % n).cast("int")), word)
    if 0 < len(lexicon) <= SOUGHT and all(re.match(r"[a-z]+\Z", token) for token in lexicon):
        found.pattern = _sought(lexicon)
    return found


def _cased(piece: Column, found: Column) -> Column:
    """The repair in the case of the word that it replaces; the word itself without one."""
    capital = F.concat(F.upper(F.left(found, F.lit(1))), F.substr(found, F.lit(2)))
    cased = (
        F.when((piece == F.upper(piece)) & (F.length(piece) > 1), F.upper(found))
        .when(F.left(piece, F.lit(1)) != F.lower(F.left(piece, F.lit(1))), capital)
        .otherwise(found)
    )
    return F.when(found.isNull(), piece).otherwise(cased)


def repaired_by(text: Column, found: Callable[[Column], Column]) -> Column:
    """The repaired text and the number of its repaired words, as a struct (text, n).

    A text is cut once and each word looked up once; one without repairs is returned as it is. It is
    cut at the words of the lexicon alone if ``found`` tells a pattern of them.
    Words of capitals only, of two letters or more, give capitals; a capital initial gives a
    capital initial; others lower case.
    """

    def told(pairs: Column) -> Column:
        n = F.size(F.filter(pairs, lambda p: p["repair"].isNotNull()))
        made = F.array_join(F.transform(pairs, lambda p: _cased(p["piece"], p["repair"])), "")
        return F.struct(F.when(n > 0, made).otherwise(text).alias("text"), n.alias("n"))

    paired = lambda ws: F.transform(ws, lambda w: F.struct(w.alias("piece"), found(F.lower(w)).alias("repair")))
    if pattern := getattr(found, "pattern", None):

        def told_between(words: Column) -> Column:
            said = F.zip_with(F.split(text, pattern, -1), paired(words), lambda part, p: F.concat(part, F.coalesce(_cased(p["piece"], p["repair"]), F.lit(""))))
            n = F.size(words)
            return F.struct(F.when(n > 0, F.array_join(said, "")).otherwise(text).alias("text"), n.alias("n"))

        return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), told_between)[0]
    return F.transform(F.array(paired(_pieces(text))), told)[0]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _looked_up(words: pa.Array, tokens: pa.Array, repairs: pa.Array) -> pa.Array:
    """Each row's words by its own entries, which are hashed once a row; a row without entries gives null."""
    rows = zip(words.to_pylist(), tokens.to_pylist(), repairs.to_pylist(), strict=True)
    return pa.array([None if w is None or t is None else list(map(dict(zip(t, r, strict=True)).get, w)) for w, t, r in rows], pa.list_(pa.string()))


def repaired_with(text: Column, tokens: Column, repairs: Column) -> Column:
    """As ``repaired_by``, by entries that each row has in two arrays; null arrays have none."""
    pieces = _pieces(text)
    found = _looked_up(F.transform(pieces, F.lower), tokens, repairs)
    n = F.coalesce(F.size(F.filter(found, lambda r: r.isNotNull())), F.lit(0))
    made = F.when(n > 0, F.array_join(F.zip_with(pieces, found, _cased), "")).otherwise(text)
    return F.when(text.isNotNull(), F.struct(made.alias("text"), n.alias("n")))


def repair(text: Column, lexicon: Mapping[str, str]) -> Column:
    """Replace whole words by an audited lexicon, keeping their case. Keys are lower-case words."""
    return repaired_by(text, lookup(lexicon))["text"]


def repair_counted(text: Column, lexicon: Mapping[str, str]) -> Column:
    """The repaired text and the number of its repaired words, as a struct (text, n)."""
    return repaired_by(text, lookup(lexicon))


def lower_words(text: Column) -> Column:
    """The distinct lower-case pieces of a text, as a lexicon's keys are sought among."""
    return F.array_distinct(F.transform(_pieces(text), F.lower))


def repaired_words(text: Column, lexicon: Mapping[str, str]) -> Column:
    """The lower-case words of a text that the lexicon repairs, with repeats."""
    found = lookup(lexicon)
    if pattern := getattr(found, "pattern", None):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    return F.filter(F.transform(_pieces(text), F.lower), lambda w: found(w).isNotNull())


def lexicon_by_loss(words: Iterable[str], lost: str = "rt") -> dict[str, str]:
    """A lexicon by rule: correct words that hold a letter pair, keyed by what remains without it."""
    out: dict[str, str] = {}
    for word in sorted({w.lower() for w in words}):
        if lost in word:
            out.setdefault(word.replace(lost, "", 1), word)
    return out


def strip_answer_key(text: Column) -> Column:
    """Drop an answer-key opening; a text that only cites a reference becomes empty."""
    cleaned = F.regexp_replace(strip(text), KEY_LEAD_IN, "")
    cleaned = strip(F.regexp_replace(cleaned, KEY_PREFIX, ""))
    return F.when(F.rlike(cleaned, F.lit(REFERENCE_ONLY)), "").otherwise(cleaned)


def option_dependent(gold: Column) -> Column:
    """The first rule by which a gold answer depends on its options, or null."""
    return F.coalesce(*[F.when(F.rlike(gold, F.lit(rule)), F.lit(name)) for name, rule in OPTION_RULES])


def sentences(text: Column) -> Column:
    """A text cut after full stops, exclamation and question marks before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def chunks(text: Column, *, size: int = 600, overlap: int = 100, least: int = 40) -> Column:
    """Cut a text into overlapping chunks of whole sentences.

    Sentences are added while the chunk with one more and a space keeps to the size. The next
    chunk starts with the last ``overlap`` characters of the one before, from their first
    space; without a space with nothing. What grows beyond twice the size is cut hard, with the
    overlap. Chunks shorter than ``least`` are dropped. A short text is its own chunk.
    """
    if not 0 < overlap < size:
        raise ValueError("the overlap must be positive and less than the size")
    folded = fold_space(text)

    def start(cur: Column, sentence: Column) -> Column:
        tail = F.right(cur, F.lit(overlap))
        at = F.instr(tail, " ")
        kept = F.when(at > 0, F.substr(tail, at + 1)).otherwise(F.lit(""))
        return F.trim(F.concat(kept, F.lit(" "), sentence))

    def cut(state: Column, _: Column) -> Column:
        cur = state["cur"]
        long = F.length(cur) > 2 * size
        return F.struct(
            F.when(long, F.concat(state["out"], F.array(F.left(cur, F.lit(size))))).otherwise(state["out"]).alias("out"),
            F.when(long, F.trim(F.substr(cur, F.lit(size - overlap + 1)))).otherwise(cur).alias("cur"),
        )

    def add(state: Column, sentence: Column) -> Column:
        cur = state["cur"]
        full = (cur != "") & (F.length(cur) + F.length(sentence) + 1 > size)
        plain = F.when(cur == "", sentence).otherwise(F.concat(cur, F.lit(" "), sentence))
        grown = F.struct(
            F.when(full, F.concat(state["out"], F.array(cur))).otherwise(state["out"]).alias("out"),
            F.when(full, start(cur, sentence)).otherwise(plain).alias("cur"),
        )
        times = F.greatest(F.lit(0), F.ceil((F.length(cur) + F.length(sentence) + 1) / (size - overlap)).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), times), grown, cut)

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(sentences(folded), first, add, lambda s: F.concat(s["out"], F.when(s["cur"] != "", F.array(s["cur"])).otherwise(F.array().cast("array<string>"))))
    kept = F.filter(F.transform(packed, lambda c: F.trim(c)), lambda c: F.length(c) >= least)
    whole = F.when(F.length(folded) >= least, F.array(folded)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(folded) <= size, whole).otherwise(kept)


def passage_key(text: Column) -> Column:
    return F.sha1(text)


def passage_id(prefix: str, text: Column, index: Column) -> Column:
    """prefix, the index in eight digits and twelve digits of the text's SHA-1."""
    return F.concat_ws("-", F.lit(prefix), F.lpad(index.cast("string"), 8, "0"), F.left(F.sha1(text), F.lit(12)))


def content_hash(question: Column, options: Column) -> Column:
    """SHA-256 of the question and its options in order, stripped and in lower case."""
    parts = F.concat(F.array(question), options)
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.lower(strip(p))), PART_MARK), 256)


def split_stem(question: Column, fraction: float = 0.5) -> Column:
    """The first share of the words, one at least, and the rest, as a struct."""
    words = F.filter(F.split(question, r"(?U)\s+"), lambda w: w != "")
    at = F.greatest(F.lit(1), F.floor(F.size(words) * fraction).cast("int"))
    return F.struct(
        F.array_join(F.slice(words, F.lit(1), at), " ").alias("prefix"),
        F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ").alias("rest"),
    )


def parse_score(reply: Column) -> Column:
    """The judge's 0, 1 or 2; null if there is none, which isn't 0."""
    return F.nullif(F.regexp_extract(reply, r"(?i)SCORE\s*:\s*([0-2])", 1), F.lit("")).cast("int")


def parse_verdict(reply: Column) -> Column:
    """A, B or TIE; neither and both are ties; null if there is none."""
    said = F.upper(F.regexp_extract(reply, r"(?i)VERDICT\s*:\s*(TIE|NEITHER|BOTH|A|B)\b", 1))
    return F.when(said.isin("TIE", "NEITHER", "BOTH"), "TIE").otherwise(F.nullif(said, F.lit("")))


def flip(verdict: Column) -> Column:
    return F.when(verdict == "A", "B").when(verdict == "B", "A").otherwise(verdict)


def run_stem(arm: Column, seed: Column, tag: Column | None = None) -> Column:
    """The name of a run: its arm with its seed, or with a tag instead."""
    by_seed = F.concat(arm, F.lit("_seed"), seed.cast("string"))
    return by_seed if tag is None else F.coalesce(F.concat(arm, F.lit("_"), tag), by_seed)


def run_arm(stem: Column) -> Column:
    """The arm of a run's name with a seed; null for other names."""
    return F.nullif(F.regexp_extract(stem, r"^(.+)_seed[0-9]+$", 1), F.lit(""))


def run_seed(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"^.+_seed([0-9]+)$", 1), F.lit("")).cast("int")


def insertions(token: Column, pair: str) -> Column:
    """The token with the letter pair put in after each of its letters."""
    return F.transform(
        F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.left(token, i), F.lit(pair), F.substr(token, i + 1))
    )


def holds_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Whether all phrases occur in the text, whatever its white space and case."""
    seen = normalise_phrase(text)
    return F.forall(F.array(*[F.lit(" ".join(p.lower().split())) for p in phrases]), lambda p: F.contains(seen, p))


def extract_reply(response: Column) -> Column:
    """The reply in a chat completion; null where it's malformed or absent."""
    return F.get_json_object(response, "$.choices[0].message.content")


def card_results(text: Column) -> Column:
    """Rows of a result table in a card: from each arm to its numbers."""
    row = r"(?m)^\|\s*`?([a-z][a-z0-9-]*)`?\s*\|\s*([0-9.]+)\s*%\s*(?:\[\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\])?[^\n]*\|\s*$"
    group = lambda i: F.regexp_extract_all(text, F.lit(row), F.lit(i))
    value = lambda i: F.transform(group(i), lambda x: F.nullif(x, F.lit("")).cast("double"))
    entries = F.arrays_zip(value(2).alias("accuracy"), value(3).alias("low"), value(4).alias("high"))
    return F.map_from_arrays(group(1), entries)


def parse_options(text: Column) -> Column:
    """Up to four options from lines, without their labels and blank lines."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x != "")
    return F.slice(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[A-Da-d][.):]\s*", ""))), F.lit(1), F.lit(4))


def picker_label(text: Column, limit: int = 90) -> Column:
    """A label of at most ``limit`` characters; longer texts end with an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("…"))).otherwise(text)


#: Factor by which a double is split into halves whose products are exact.
HALVES = float((1 << 27) + 1)


def fixed(value: Column, digits: int, *, plus: bool = False) -> Column:
    """A double with so many decimals, as C's ``%.nf``, or ``%+.nf`` with ``plus``: rounded by its exact binary value, half to even.

    Spark's ``format_string`` rounds the shortest decimal form half up, so that 0.00015, which is a
    little less, becomes 0.0002. Here the product with the power of ten is kept exactly, as a sum
    of two doubles. Values of 2**52 and more after scaling have no such ties, nor have infinities.
    """
    scale = float(10**digits)
    high_scale = scale * HALVES - (scale * HALVES - scale)
    x = value.cast("double")

    def told(v: Column) -> Column:
        size = F.abs(v)
        high = size * HALVES - (size * HALVES - size)
        low, product = size - high, size * scale
        rest = ((high * high_scale - product) + high * (scale - high_scale) + low * high_scale) + low * (scale - high_scale)
        whole = F.floor(product)
        over = product - whole
        up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
        n = whole + F.when(up, 1).otherwise(0)
        text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), "0")
        shown = F.concat(F.left(text, F.length(text) - digits), F.lit("." if digits else ""), F.right(text, F.lit(digits)))
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
        return F.when(size * scale < float(1 << 52), F.concat(sign, shown)).otherwise(F.format_string(f"%{'+' if plus else ''}.{digits}f", v))

    return F.when(x.isNotNull(), F.transform(F.array(x), told)[0])


def percent(share: Column) -> Column:
    """One decimal and a percent sign, from a share of 0 to 1."""
    return F.concat(fixed(share * 100, 1), F.lit("%"))


def p_value(p: Column) -> Column:
    """A p-value for a table: three decimals, four below 0.001, powers of ten below 0.0001."""
    return F.when(p < 1e-4, F.format_string("%.1e", p)).when(p < 1e-3, fixed(p, 4)).otherwise(fixed(p, 3))
