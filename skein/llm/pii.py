"""Personal data: validated patterns, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup
from .common import hinted, let, store

#: The kinds in their order and their patterns. A match may start only where a
#: run of its first characters starts or where the match before has ended, and runs are taken
#: whole: so long runs are read once, and the leftmost matches are those of the plain forms.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What looks like an identifier: a run with a digit, of 5 characters or more without the marks around it.
#: A run is read from its start alone, so a long one without a digit is read once.
LIKE = r"(?<![A-Za-z0-9_./+@-])(?=[A-Za-z_./+@-]*+[0-9])[_./+@-]*+[A-Za-z0-9][A-Za-z0-9_./+@-]{4,}(?<=[A-Za-z0-9])"
MARKS = r"^[_./+@-]+"

#: A word of a context: quotes and brackets are no part of it, and =, : and # end it.
TOKEN = r"[^\s\x22'()\[\]<>=:#]*+[=:#]+|[^\s\x22'()\[\]<>=:#]++"

#: Instances that are no words or plain numbers by their form: 16 characters or more that go from letters to digits and back.
CODED = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})(?=(?:[A-Za-z_+/-]*+[0-9]++[_+/-]*+[A-Za-z]){3})[A-Za-z0-9_+/-]{16,}$"

#: Patterns up to which they are sent to the tasks as a constant.
CONSTANT = 50_000

#: Spans back that an instance's two words are sought in: spans of one kind don't overlap, so three of a kind are among them.
BACK = 12


def _found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping: an array of start, end and match, in code points.

    The pieces between the matches and the matches themselves give the places by their lengths.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    state = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("spans")
    )

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("match"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    return F.aggregate(F.filter(parts, lambda p: p["hit"].isNotNull()), state, step)["spans"]


def like_spans(text: Column) -> Column:
    """What looks like an identifier in a text: an array of start, end and match."""

    def bare(s: Column) -> Column:
        match = F.regexp_replace(s["match"], MARKS, "")
        return F.struct((s["end"] - F.length(match)).alias("start"), s["end"].alias("end"), match.alias("match"))

    return F.filter(F.transform(_found(text, LIKE), bare), lambda s: F.length(s["match"]) >= 5)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def added(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return s + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), added) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        low = lambda part: let(F.regexp_replace(part, "^0+(?=.)", ""), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
        return F.forall(F.split(match, r"\."), low)
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda m: _valid(kind, m["match"]))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid matches in the whole text: start, end, match; null has none.

    Texts without the characters that a kind can't do without aren't searched for it.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    out = {}
    for kind in KINDS:
        need = needs.get(kind, F.rlike(text, F.lit("[0-9]")))
        out[kind] = F.coalesce(F.when(need, _checked(_found(text, PATTERNS[kind]), kind)), none)
    return out


def _plain(text: Column) -> Column:
    """Lower-cased, digits as 0."""
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(_plain(text), F.lit(TOKEN), F.lit(0))


def _shape(match: Column) -> Column:
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    return F.when(F.rlike(match, F.lit(CODED)), F.concat(F.lit("coded"), F.length(match).cast("string"))).otherwise(kinds)


def _contexts(text: Column, spans: Column, coded: bool = True) -> Column:
    """Instances (start, end, match, seed; sorted) with their patterns.

    Patterns are the two words before (``l2``), the word before (``l1``), the word after
    (``r1``) and the shape (``s0``). Something that stands before or after without white space
    or a mark between is no context.
    """

    def made(all_: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            first = F.coalesce(F.get(all_, i - BACK)["start"], F.lit(0))
            before = F.substr(text, first + 1, s["start"] - first)
            after = F.regexp_extract(F.substr(text, s["end"] + 1), r"^[\x22')\]>.,;:!?]*+\s++([^\s\x22'()\[\]<>=:#]++[=:#]*+|[=:#]++)", 1)
            left = F.when(F.rlike(before, F.lit(r"[\s\x22'(\[<=:#]$")), _tokens(before))

            def patterns(w: Column) -> Column:
                n = F.size(w)
                near = F.when(n > 0, F.concat(F.lit("l1 "), F.get(w, n - 1)))
                far = F.when(n > 1, F.concat(F.lit("l2 "), F.get(w, n - 2), F.lit(" "), F.get(w, n - 1)))
                right = F.when(after != "", F.concat(F.lit("r1 "), _plain(after)))
                return F.filter(F.array(near, far, right, F.concat(F.lit("s0 "), _shape(s["match"]))), lambda p: p.isNotNull())

            told = s["seed"] | F.rlike(s["match"], F.lit(CODED)) if coded else s["seed"]
            return F.struct(let(left, patterns).alias("patterns"), s["match"].alias("instance"), s["start"].alias("start"), s["end"].alias("end"), s["seed"].alias("seed"), told.alias("told"))

        return F.transform(all_, one)

    return let(spans, made)


def selective(edges: DataFrame, texts: DataFrame, *, share: float = 0.5, least: int = 5) -> DataFrame:
    """The patterns of words that identifier-like strings stand at in at least this share of the words' places.

    Args:
        edges: pattern, instance, n (occurrences): distinct.
        texts: text: where the words are counted.

    Returns:
        pattern: those of at least ``least`` distinct instances.
    """
    used = edges.filter(~F.col("pattern").startswith("s0 ")).groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("n"))
    used = store(used.filter(F.col("instances") >= least).select("pattern", "n", F.substring("pattern", 4, 1 << 30).alias("words")), "used")
    pairs = lambda ws: F.concat(ws, F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1))))
    told = used.select("words").distinct()
    few = [r[0] for r in told.limit(CONSTANT + 1).collect()]
    if len(few) <= CONSTANT:  # then only places that count leave the text
        known = lookup(dict.fromkeys(few, ""))
        places = texts.select(F.explode(let(_tokens(F.col("text")), lambda ws: F.filter(pairs(ws), lambda w: known(w).isNotNull()))).alias("words"))
    else:
        places = texts.select(F.explode(let(_tokens(F.col("text")), pairs)).alias("words")).join(told, "words", "left_semi")
    places = places.groupBy("words").agg(F.count(F.lit(1)).alias("places"))
    met = used.join(hinted(store(places, "places")), "words", "left")
    return store(met.filter(F.col("n") >= share * F.coalesce("places", F.lit(0))).select("pattern"), "selective")


def score_patterns(edges: DataFrame, *, rounds: int = 3, trust: float = 0.8, least: int = 5) -> DataFrame:
    """Score the graph of patterns and instances in turns, and name the trusted patterns.

    An instance told by itself (a seed, or coded by its form) counts 1 for good. In each round a
    pattern's confidence is the sum of its instances' scores over their number plus one; then
    another instance's score is the best confidence of its trusted patterns, or 0 without any.
    So instances that trusted patterns find vouch for further patterns.

    Args:
        edges: pattern, instance, told: a row per occurrence or per distinct triple.
        least: distinct instances of positive score that a trusted pattern needs.

    Returns:
        pattern, confidence, support.
    """
    edges = store(edges.groupBy("pattern", "instance").agg(F.max("told").alias("told")), "edges")
    told = edges.groupBy("instance").agg(F.max("told").alias("told"))
    scores = store(told.select("instance", F.col("told").cast("double").alias("score"), "told"), "scores")
    trusted = None
    for turn in range(rounds):
        met = edges.select("pattern", "instance").join(scores, "instance")
        trusted = met.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if(F.col("score") > 0).alias("support")
        )
        trusted = store(trusted.filter((F.col("support") >= least) & (F.col("confidence") >= trust)), "patterns")
        if turn + 1 < rounds:
            voted = edges.select("pattern", "instance").join(hinted(trusted), "pattern", "left")
            voted = voted.groupBy("instance").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("best"))
            scores = store(
                scores.join(voted, "instance").select("instance", F.when(F.col("told"), 1.0).otherwise(F.col("best")).alias("score"), "told"), "scores"
            )
    return trusted


def _numbered(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_private(docs: DataFrame, *, rounds: int = 3, trust: float = 0.8, least: int = 5, coded: bool = True) -> DataFrame:
    """Find personal data in every whole text.

    The base kinds are found by pattern and checked. They and strings coded by their form tell
    which contexts to trust: one or two words before or the word after an instance, at half of
    whose places something like an identifier stands, and whose instances nearly all are known,
    coded, or vouched for by other trusted contexts or shapes. What looks like an identifier in
    a trusted context is one, of kind ``id``; a coded string in no trusted context is not. Such
    finds never replace or overlap a base span.

    Args:
        coded: whether strings coded by their form are seeds too; else only the base kinds are.

    Returns:
        doc_id, spans (array of start, kind, end; by start, then kind as listed), base (those of
        the base kinds): a row per input row, repeated rows included. Null and empty texts have
        none. Texts of any length are searched whole. Places are code points, the end exclusive.
        Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))
    digits = F.rlike(F.col("text"), F.lit("[0-9]"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    rows = rows.withColumn("like", F.when(digits, like_spans(F.col("text"))).otherwise(none))
    known = F.concat(*KINDS)
    fresh = F.filter("like", lambda x: ~F.exists(known, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])))
    as_ = lambda spans, seed: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.lit(seed).alias("seed")))
    contexts = _contexts(F.col("text"), F.sort_array(F.concat(as_(known, True), as_(fresh, False))), coded)
    listed = [_numbered(F.col(k), i) for i, k in enumerate(KINDS)]
    rows = store(
        rows.select(
            "row", "doc_id", F.concat(*listed).alias("base"),
            F.when(F.size(F.concat(known, F.col("like"))) > 0, contexts).alias("contexts"),
        ),
        "found",
    )
    seen = rows.select("row", F.inline("contexts"))
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "told")
    edges = store(edges.groupBy("pattern", "instance").agg(F.max("told").alias("told"), F.count(F.lit(1)).alias("n")), "edges")
    some = selective(edges, docs.select(text.alias("text")), least=least)
    shapes = F.col("pattern").startswith("s0 ")
    edges = edges.filter(shapes).unionByName(edges.join(hinted(some), "pattern", "left_semi"))
    trusted = score_patterns(edges, rounds=rounds, trust=trust, least=least).filter(~shapes)
    more = seen.filter("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    more = more.join(hinted(trusted.select("pattern")), "pattern", "left_semi")
    more = more.groupBy("row").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more")
    )
    out = rows.select("row", "doc_id", "base").join(hinted(store(more, "more")), "row", "left")
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])

    def named(spans: Column) -> Column:
        return F.transform(F.sort_array(spans), lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return out.select("doc_id", named(F.concat("base", F.coalesce("more", empty))).alias("spans"), named(F.col("base")).alias("base"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
