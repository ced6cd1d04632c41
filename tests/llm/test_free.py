"""Mixing, packing, the Jaccard join, lattice scores, page text and the line CRF."""

import math
import random
import re
import zlib
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import crf, graph, htmltext, lattice, mixing, overlap, packing

DOCS = "doc_id long, source string, text string"


def corpus(seed=0, n=300, sources=("a", "b", "c", "d", None)):
    rng = random.Random(seed)
    rows = [(i, sources[0] if i % 3 == 0 else rng.choice(sources), " ".join(["w"] * rng.choice((0, 1, 5, 40, 200)))) for i in range(n)]
    return [*rows, (n, "tiny", "one two"), (n + 1, "none", None), (n + 1, "none", None)]


def fair_targets(sizes, cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s], left = cap * sizes[s], left - cap * sizes[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rows = corpus(1, 900)
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit(7), "target": F.lit("t"), "cut": F.lit(0)})
    got = [r.asDict() for r in mixing.mix(df).collect()]
    again = [r.asDict() for r in mixing.mix(df.repartition(9)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    source = {r[0]: r[1] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows)
    want = fair_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 201
    out = mixing.resample(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in got if r["size"])


def test_mix_edges(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.resample(df).count() == 0
    same = spark.createDataFrame([(1, "a", "x y")] * 40, DOCS)
    assert sum(r["taken"] for r in mixing.mix(same).collect()) == pytest.approx(80, abs=80)


def test_token_ids_match_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    ids = packing.TokenIds(packing.default_vocabulary())
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b", "a\n b \n\n c ", "don't we'll", "é 漢字 𝄞", "a  b", " x", "<|endoftext|> end", "tail "]
    texts += ["".join(rng.choice("ab \n\té.,'1") for _ in range(200)) for _ in range(200)]
    for text in texts * 2:
        assert np.frombuffer(ids.bytes(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_best_fit_respects_every_capacity(score):
    rng = random.Random(4)
    counts = {}
    for _ in range(5000):
        n = min(64, 1 + int(rng.expovariate(0.1)))
        counts[n] = counts.get(n, 0) + 1
    placed = packing.vector_best_fit(counts, capacity=64, max_docs=5, max_cost=2500 + 64 * 64 - 2500, weights=(1, 0.2, 0.2), score=score)
    bins, seen = {}, {}
    for length, first, n, start, offset in placed:
        for i in range(n):
            bins.setdefault(start + i, []).append((offset, length))
            seen.setdefault(length, []).append(first + i)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and len(own) <= 5 and sum(x * x for _, x in own) <= 64 * 64
    short = {n: c for n, c in counts.items() if n <= 40}
    for limits, binding in (({"max_docs": 64, "max_cost": 1600}, 2), ({"max_docs": 3, "max_cost": 64 * 64}, 1)):
        bins = {}
        for length, _, n, start, offset in packing.vector_best_fit(short, capacity=64, **limits, weights=(1, 0.2, 0.2), score=score):
            for i in range(n):
                bins.setdefault(start + i, []).append(length)
        loads = [(sum(own), len(own), sum(x * x for x in own)) for own in bins.values()]
        assert all(t <= 64 and d <= limits["max_docs"] and c <= limits["max_cost"] for t, d, c in loads)
        assert sum(len(own) for own in bins.values()) == sum(short.values())
        one = min(short)  # some bin has room for a short item's tokens, but not for its document or cost
        assert any(t + one <= 64 and (d + 1 > limits["max_docs"] if binding == 1 else c + one * one > limits["max_cost"]) for t, d, c in loads)
    with pytest.raises(ValueError, match="exceeds"):
        packing.vector_best_fit({5: 1}, capacity=8, max_docs=1, max_cost=10, weights=(1, 1, 1))


def test_pack_places_every_piece(spark):
    rng = random.Random(6)
    rows = [(i, "s", " ".join(rng.choice(("the", "of", "zebra")) for _ in range(rng.randrange(150)))) for i in range(150)]
    rows += [(200, None, None), (201, "s", ""), (202, "s", "x " * 700), (202, "s", "x " * 700), (None, "s", "null id")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit(1), "piece": F.lit(2)})
    got = packing.pack(df, capacity=128).collect()
    ids = packing.TokenIds(packing.default_vocabulary())
    want = {}
    for doc, _, text in rows:
        want.setdefault(doc, []).append(np.frombuffer(ids.bytes(text or ""), "<u4").tolist() + [0])
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        options = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for t in want[r["doc_id"]]}
        assert r["ids_crc32"] in options
    assert sum(r["length"] for r in got) == sum(len(t) for ts in want.values() for t in ts)
    assert all(r["length"] == 128 or r["piece"] == 0 for r in got)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 128 + 1
    assert packing.pack(df.limit(0), capacity=128).count() == 0


def test_pack_tokenizes_bounded_batches(spark, monkeypatch):
    """A task holds few texts at once, by number and by bytes, and leaves the session's settings as they were."""
    plain, key = packing.map_rows, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(df, made, fields):
        def small(batches):
            for batch in batches:
                assert "text" not in batch.schema.names or batch.num_rows <= 1000 and batch.nbytes <= 8 << 20
                yield batch

        return plain(df, lambda batches: made(small(batches)), fields)

    monkeypatch.setattr(packing, "map_rows", watched)
    before = spark.conf.get(key)
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.repeat(F.lit("some words "), 20_000)).alias("text"))
    got = packing.pack(df, capacity=2048).groupBy("piece").count().collect()
    assert {r["piece"]: r["count"] for r in got}[0] == 3000 and spark.conf.get(key) == before


def near_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts = []
    for base in range(25):
        ws = [word() for _ in range(rng.choice((3, 6, 40, 120, 300)))]
        if base % 3 == 0:
            ws += shared
        texts.append(" ".join(ws))
        for _ in range(rng.randrange(6)):
            own = list(ws)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        for step in range(0, 30, 6):  # a chain: each links with the next
            texts.append(" ".join(ws[step:] + [word() for _ in range(step)]))
    big = [word() for _ in range(100)]
    texts += [" ".join(big[:50] + [word()] + big[50:]) for _ in range(80)]
    return [*texts, "", None, "One Two", "one two", "ONE", "a b c d e", "A b\nc  d\te"]


def plain_components(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = comp[a], comp[b]
                for k in comp:
                    if comp[k] in (x, y):
                        comp[k] = min(x, y)
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 16, "ROUNDS": 1, "SPARSE": 1, "COMMON": 2, "SLOTS": 400, "SENDS": 3}])
def test_jaccard_components_match_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():  # small blocks, so that buckets are cut; few rounds, so that the trees do the work
        monkeypatch.setattr(overlap, name, value)
    rows = list(enumerate(near_texts()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(0), "rep": F.lit(1), "key": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap.jaccard_components(df).collect()}
    assert got == plain_components(rows)
    kept = overlap.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_jaccard_components_edges(spark):
    schema = "doc_id long, text string"
    assert overlap.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (5, None), (6, "")]
    got = sorted(map(tuple, overlap.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 4), (9, 2, 4), (9, 2, 4), (5, 0, 5), (6, 0, 6)], key=str)


def test_many_near_copies_of_a_long_text(spark, monkeypatch):
    """A large group of long sets passes through tasks by bytes; no batch holds more than a few sets."""
    monkeypatch.setattr(overlap, "SEND_BYTES", 1 << 20)
    monkeypatch.setattr(overlap, "SENDS", 150)
    rng = random.Random(9)
    base = [f"{rng.randrange(1 << 40):x}" for _ in range(25_000)]
    text = F.concat(F.lit(" ".join(base[:9000])), F.lit(" v"), F.col("id").cast("string"), F.lit(" "), F.lit(" ".join(base[9000:])))
    docs = spark.range(0, 600, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"))
    other = spark.createDataFrame([(1000, " ".join(base[:12_000])), (1001, "a b c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap.jaccard_components(docs.unionByName(other)).collect()}
    assert got == {k: (24_997, 0) for k in range(600)} | {1000: (11_996, 1000), 1001: (1, 1001)}


def test_rtree_leaves_out_no_pair_within_the_bound():
    rng = np.random.default_rng(3)
    sizes = rng.integers(5, 400, 300)
    points = np.stack([np.bincount(rng.integers(0, overlap.GROUPS, n), minlength=overlap.GROUPS) for n in sizes])
    for k in range(0, 290, 7):  # near copies
        points[k + 1] = np.maximum(points[k] - (rng.random(overlap.GROUPS) < 0.03), 0)
        sizes[k], sizes[k + 1] = points[k].sum(), points[k + 1].sum()
    parts = rng.integers(0, 150, 300)
    got = {tuple(sorted(p)) for x, y in overlap.RTree(sizes, points, parts).pairs() for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = set()
    for a in range(300):
        for b in range(a):
            least = np.minimum(points[a], points[b]).sum()
            ratio = 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b])
            if parts[a] != parts[b] and ratio and 175 * least >= 75 * (sizes[a] + sizes[b]):
                want.add((b, a))
    assert want <= got and len(got) < 300 * 299 / 8


def test_blocks_of_a_bucket_give_each_pair_once():
    rng = np.random.default_rng(5)
    sizes, parts, own = np.full(90, 100), np.arange(90) // 2, rng.integers(0, 3, 90)
    points = np.tile(np.bincount(rng.integers(0, overlap.GROUPS, 100), minlength=overlap.GROUPS), (90, 1))
    got = []
    for low in range(3):
        for high in range(low, 3):
            at = np.flatnonzero((own == low) | (own == high))
            pairs = overlap._block_pairs(own[at], low, high, sizes[at], points[at], parts[at])
            got += [tuple(sorted(p)) for x, y in pairs for p in zip(at[x].tolist(), at[y].tolist(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(90) for b in range(a + 1, 90) if parts[a] != parts[b]]


def test_prefixes_show_what_a_link_must_share():
    rng = random.Random(6)
    for _ in range(3000):
        n = rng.randrange(1, 120)
        y = set(range(n))
        x = set(rng.sample(sorted(y), rng.randrange(1, n + 1))) | {1000 + k for k in range(rng.randrange(0, 20))}
        order = list(range(2000))
        rng.shuffle(order)
        first = lambda s: set(sorted(s, key=order.__getitem__)[: int(overlap.prefix_length(len(s)))])  # noqa: B023, E731
        if 100 * len(x & y) >= 75 * len(x | y):
            assert len(first(x) & first(y)) >= overlap.pair_shown(len(x), len(y))
    n, m = np.meshgrid(np.arange(1, 900), np.arange(1, 900))
    can = (100 * n >= 75 * m) & (100 * m >= 75 * n)
    assert (overlap.pair_shown(n, m) >= overlap.least_shown(n))[can].all()


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def all_segmentations(v, logs, word):
    piece = {h: i for h, i in zip(v.hashes.tolist(), v.ids.tolist(), strict=True)}

    def plain(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(word) + 1):
            i = piece.get(v._hash(word[at:end]))
            if i is not None:
                total += math.exp(logs[i]) * plain(end)
            elif end == at + 1:
                total += math.exp(sum(logs[v.bytes[b]] for b in word[at].encode())) * plain(end)
        return total

    return plain(0)


def test_frequent_words_are_whole_classes_of_counts(spark, monkeypatch):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([1] * 30 + [2] * 9 + [5, 9, 700])]
    df = spark.createDataFrame(rows, "word binary, c long")
    for head, n in ((0, 0), (1, 1), (3, 3), (11, 3), (12, 12), (100, 42)):
        monkeypatch.setattr(lattice, "HEAD", head)
        assert len(lattice.frequent_words(df)) == n


def test_lattice_sums_all_segmentations():
    v = lattice.Vocabulary(lattice.default_vocabulary())
    logs = v.first_weights()
    words = ["the", "thonhe", "ère", "漢字x", "a", "übergeben", '"', "ab́c"]
    got = lattice.word_logs(v, logs, [w.encode() for w in words])
    assert got == pytest.approx([math.log(all_segmentations(v, logs, lattice.START + w)) for w in words])
    assert np.isfinite(lattice.word_logs(v, logs, [("q" * 5000).encode()]))[0]
    uses = np.zeros(v.size)
    lattice.Lattice(v, logs, ["hello"]).expected(np.array([1.0]), uses)
    at = np.flatnonzero(uses)
    nudged = logs.copy()
    nudged[at[0]] += 1e-6  # the expected use of a piece is the derivative of the log probability
    rise = (lattice.word_logs(v, nudged, [b"hello"]) - lattice.word_logs(v, logs, [b"hello"]))[0] / 1e-6
    assert rise == pytest.approx(uses[at[0]], abs=1e-4)
    same = ["hello", "h漢zzl", "\U0001d11e" * 5]
    one, two = np.zeros(v.size), np.zeros(v.size)
    lattice.Lattice(v, logs, same).expected(np.array([1.0, 2.0, 3.0]), one)
    lattice.expected_uses(v, logs, same, np.array([1.0, 2.0, 3.0]), two)
    assert two == pytest.approx(one)
    long = ["q" * 400 + "\U0001d11e" * 50]  # beyond the least number
    lattice.Lattice(v, logs, long).expected(np.array([1.0]), one)
    lattice.expected_uses(v, logs, long, np.array([1.0]), two)
    assert two == pytest.approx(one)


def test_lattice_scores(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 3)
    fitted = []
    monkeypatch.setattr(lattice, "fit_weights", lambda *args, fit=lattice.fit_weights: fitted.append(fit(*args)) or fitted[-1])
    rng = random.Random(9)
    words = ["the", "The", "of", "erand", "stithe", "onre", "ünd", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, None), (501, ""), (None, "the of"), (7, "the\x85of")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(0), "score": F.lit("s"), "word": F.lit(1)})
    got = lattice.score_texts(df).collect()
    counts = {}
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for w in [*(t or "").encode().lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), None]
        want.append((str(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["word_arc_score"]) and r["word_arc_score"] < 0 for r in got)
    assert sum(r["word_arc_score"] for r in got) > sum(r["score"] for r in got)
    v, memo = lattice.Vocabulary(lattice.default_vocabulary()), {}
    one = lambda w: memo.setdefault(w, math.log(all_segmentations(v, fitted[0], lattice.START + w)))
    total = lambda t: (sum(one(w.decode()) for w in (t or "").encode().lower().split()) + fitted[0][v.end]) / math.log(10)
    scores = lambda pairs: sorted((str(i), round(x, 8)) for i, x in pairs)
    assert scores((r["doc_id"], r["score"]) for r in got) == scores((i, total(t)) for i, t in rows)
    assert lattice.score_texts(df.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside>%s<section id="comments"><p>First! A rather long comment by a reader of the page, of many words.</p></section>
<form><p>Subscribe</p><input></form><footer>&copy; me</footer></body></html>"""
BODY = """<h1>A &amp; B</h1><p>First   paragraph<br>with <b>bold</b> words that go on for quite a while, as text does.</p><p>Short.</p>
<div class="ad">Buy</div><ul><li>one</li><li>two &lt;x&gt;</li></ul><p>Last paragraph of the text, again of some length, with an end."""
WANT = "A & B\nFirst paragraph with bold words that go on for quite a while, as text does.\nShort.\none\ntwo <x>\nLast paragraph of the text, again of some length, with an end."


def test_main_text():
    assert htmltext.main_text(PAGE % f"<article>{BODY}</article>") == WANT
    assert htmltext.main_text(PAGE % f"<main>{BODY}</main>") == WANT
    assert htmltext.main_text(PAGE % f'<div id="content">{BODY}</div>') == WANT
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("<article><p>cut off he<a hre") == "cut off he"
    assert htmltext.main_text("just text") == "just text"
    assert htmltext.main_text('<div class="ad">x<article><p>kept</p></article>') == "kept"
    assert htmltext.main_text("<article>" + "<b>" * 3000 + "deep" + "<p>x" * 3000) == "deep" + "\nx" * 3000


def test_main_text_keeps_all_regions():
    long, other, short = ("words of a text that goes on for a while " * n for n in (9, 8, 2))
    long, other, short = long.strip(), other.strip(), short.strip()
    menu = "<div>" + "".join(f"<a href=/{i}>go {i}</a><br>" for i in range(9)) + "</div>"
    parts = f"<div><p>{long}</p></div><div><p>{other}</p></div>"
    assert htmltext.main_text(f"<body>{menu}<div id=content>{parts}</div></body>") == f"{long}\n{other}"
    assert htmltext.main_text(f"<body>{menu}<table><tr><td><p>{long}</p></td><td><p>{other}</p></td></tr></table></body>") == f"{long}\n{other}"
    quoted = f"<div id=content><p>{other}</p><blockquote><p>{long}</p><p>{long}</p></blockquote><p>{short}</p></div>"
    assert htmltext.main_text(f"<body>{menu}{quoted}</body>") == f"{other}\n{long}\n{long}\n{short}"
    assert htmltext.main_text(f"<body>{menu}<div><div><p>{long * 12}</p></div><div><p>{short}</p></div></div></body>") == f"{long * 12}\n{short}"
    assert htmltext.main_text(f"<article><p>{long * 3}</p></article><article><p>{short}</p></article>") == f"{long * 3}\n{short}"


def test_main_text_takes_names_as_weak_evidence():
    para = "words of a text that goes on for a while and then for a while more, " * 3
    para = para.strip()
    inner = f'<h1>Title</h1><p>{para}</p><p>{para}</p><h2 id="related-work">Related work</h2><p>{para}</p>'
    want = f"Title\n{para}\n{para}\nRelated work\n{para}"
    section = f'<section id="discussion"><h2>Discussion</h2><p>{para}</p></section>'
    for body in (f'<main class="with-sidebar">{inner}</main>', f'<article class="post has-comments">{inner}</article>', f'<div class="has-sidebar">{inner}</div>'):
        assert htmltext.main_text(f"<body><nav>x</nav>{body}</body>") == want
    for tag in ("article", "div"):
        page = f'<body><{tag}>{inner}{section}<div class="ad">Buy</div></{tag}><div class="ad">Buy <a href=/>now</a></div></body>'
        assert htmltext.main_text(page) == f"{want}\nDiscussion\n{para}"
    assert htmltext.main_text(f'<body><div class="has-sidebar"><article>{inner}</article></div></body>') == want


def test_main_text_leaves_out_what_stands_within_a_line():
    para = "words of a text that goes on for a while and then for a while more, " * 3
    para = para.strip()
    inline = ('<script>var x="<p>1";</script>', "<style>p{}</style>", "<noscript>no</noscript>", "<iframe>i</iframe>", "<select><option>o</option></select>",
              "<button>b</button>", "<textarea>t</textarea>", "<svg><text>s</text></svg>", '<span class="ad">Buy <a href=/>now</a></span>', '<span hidden>h</span>')
    for x in inline:
        for page in ("<article>%s</article>", "<body><nav>n</nav><div>%s</div></body>"):
            body = f"<p>{para}</p><p>{para} one{x}two</p>{x}<p>{para}</p>"
            assert htmltext.main_text(page % body) == f"{para}\n{para} onetwo\n{para}", (x, page)
        assert htmltext.main_text(f"<p>a{x}b</p>") == "ab"
    assert htmltext.main_text(f'<article><p>{para} <span class="comment">{para}</span> {para}</p></article>') == f"{para} {para}"
    assert htmltext.main_text(f'<body><div class="page has-sidebar"><p>{para}</p></div></body>') == para
    assert htmltext.main_text(f'<article class="post comments-open"><p>{para}</p></article>') == para


TEXT = ("words of a text that goes on for a while and then for a while more, " * 3).strip()
REMARK = ("a reader says at some length that this was good to read, and more of it. " * 3).strip()


def remarks(tag, name="x", n=3):
    return "".join(f'<{tag} class="{name}"><b class="author">Ann</b><time>May 1</time><p>{REMARK}</p></{tag}>' for _ in range(n))


@pytest.mark.parametrize(("html", "want"), [
    (f'<article><p>{TEXT}</p><p>{TEXT}</p><div class="comments"><p>{REMARK}</p><p>{REMARK}</p></div></article>', f"{TEXT}\n{TEXT}"),
    (f'<article><p>{TEXT}</p><div class="comments"><p>{REMARK}</p><p>{REMARK}</p></div></article>', TEXT),
    (f'<body><nav>x</nav><div><p>{TEXT}</p><p>{TEXT}</p><div class="comments"><p>{REMARK}</p></div></div></body>', f"{TEXT}\n{TEXT}"),
    (f'<article><p>{TEXT}</p><div class="advert"><p>Buy the best of all things now, it is good for you.</p></div><p>{TEXT}</p></article>', f"{TEXT}\n{TEXT}"),
    ('<p>a<span class="ad">BUY</span>b c d e f</p>', "ab c d e f"),
    (f"<main><p>{TEXT}</p></main><aside><article><p>{REMARK}</p></article></aside>", TEXT),
    (f"<aside><article><p>{REMARK}</p></article></aside><main><p>{TEXT}</p></main>", TEXT),
    (f'<body><form id="aspnetForm"><div><p>{TEXT}</p><p>Short.</p></div></form></body>', f"{TEXT}\nShort."),
    (f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul><p>{TEXT}</p></body>", TEXT),
    (f"<body><div id=page><nav><a href=/>Home</a> <a href=/>More</a><div><p>{TEXT}</p></div></div></body>", TEXT),
    (f"<nav><p>{TEXT}</p>", TEXT),
    (f"<nav><a href=/>go</a><article><p>Short one.</p></article><article><p>{TEXT * 5}</p></article>", f"Short one.\n{TEXT * 5}"),
    (f'<article><p>{TEXT}</p><pre><code>x = 1 <span class="comment"># note</span></code></pre></article>', f"{TEXT}\nx = 1 # note"),
    (f'<article><p>{TEXT}</p><section><h2>2 Comments</h2>{remarks("article", "comment")}</section></article>', TEXT),
    (f'<article><p>{TEXT}</p><p>{TEXT}</p><div><h3>Comments</h3>{remarks("div")}</div></article>', f"{TEXT}\n{TEXT}"),
    (f'<body><div id=c><p>{TEXT}</p><p>{TEXT}</p></div><ol>{remarks("li")}</ol></body>', f"{TEXT}\n{TEXT}"),
    (f"<head><title>T</title><body><p>{TEXT}</p>", TEXT),
    (f'<body><div class="sidebar-layout"><h1>Title</h1><p>{TEXT}</p></div></body>', f"Title\n{TEXT}"),
    (f'<body><div class="widget"><p>{TEXT}</p></div></body>', TEXT),
])
def test_main_text_of_odd_pages(html, want):
    assert htmltext.main_text(html) == want


class Tree(HTMLParser):
    """A whole tree of a well-formed page: nodes are [tag, attributes, children]."""

    def __init__(self, html):
        super().__init__()
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in ("br", "img", "input"):
            self.open.append(node)

    def handle_endtag(self, tag):
        while self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree_text(html):
    """Content by rules of the generator below: no element of these tags or these whole class names."""
    no_tags, no_names = ("nav", "aside", "footer", "form", "script", "button"), ("comments", "user-comments", "ad", "ad-slot", "advert", "newsletter", "share-bar", "cookie-notice", "sidebar")
    lines = [""]

    def walk(node):
        tag, attrs, children = node
        if tag in no_tags or attrs.get("class") in no_names or attrs.get("id") in no_names:
            return
        block = tag in ("p", "div", "ul", "li", "h1", "h2", "section", "article", "main", "body", "blockquote")
        lines.append("") if block else None
        for child in children:
            if isinstance(child, str):
                lines[-1] += child
            else:
                walk(child)
        lines.append("") if block else None

    walk(Tree(html).root)
    return "\n".join(filter(None, (" ".join(x.split()) for x in lines)))


@pytest.mark.parametrize("landmark", ["article", "main", "div"])
def test_main_text_agrees_with_a_walk_over_the_tree(landmark):
    rng = random.Random(landmark)
    words = lambda k: " ".join(rng.choice(("of", "the", "a stone", "caf&eacute;", "runs", "x&lt;y", "on")) for _ in range(k))
    for _ in range(150):
        paragraphs = lambda n: "".join(f"<p>{words(rng.randrange(30, 80))}</p>" for _ in range(n))
        inline = lambda: rng.choice(("", f"<p>{words(40)}<span class=ad>{words(5)}</span> {words(20)}</p>", f"<p>{words(30)}<em>{words(3)}</em><button>b</button></p>"))
        extra = lambda: rng.choice(("", f"<ul><li>{words(20)}</li><li>{words(25)}</li></ul>", f"<h2>{words(6)}</h2>", f"<blockquote><p>{words(40)}</p></blockquote>", f'<div class="advert">{paragraphs(1)}</div>', f'<div class="ad-slot">{words(4)}</div>', f'<div class="newsletter"><p>{words(9)}</p></div>', f'<div class="share-bar"><a href=/>{words(1)}</a></div>'))
        comments = rng.choice(("", f'<div class="comments">{paragraphs(rng.randrange(1, 5))}</div>', f'<section id="user-comments"><h2>{words(2)}</h2>{paragraphs(3)}</section>'))
        body = f"<h1>{words(5)}</h1>{paragraphs(2)}{extra()}{inline()}{paragraphs(1)}{extra()}{paragraphs(1)}{comments if rng.random() < 0.5 else ''}"
        after = comments if comments not in body else ""
        page = f"<body><nav><ul><li><a href=/>{words(2)}</a></li></ul></nav><div class=\"cookie-notice\">{words(12)}</div><{landmark}>{body}</{landmark}>{after}<aside><p>{words(40)}</p></aside><form><p>{words(4)}</p></form><footer>{words(5)}</footer></body>"
        assert htmltext.main_text(page) == tree_text(page), page


def plain_text(html):
    """Content by the document's tree: the words of what no element drops, a line per block element."""
    lines, open_ = [[]], []
    for tag, text in re.findall(r"<(/?[a-z0-9]+)[^>]*>|([^<]+)", html):
        name = tag.strip("/")
        if name in htmltext.BLOCKS:
            lines.append([])
        if text and not any(x in htmltext.HARD | htmltext.SOFT for x in open_):
            lines[-1].append(unescape(text))
        elif tag.startswith("/") and name in open_:
            del open_[len(open_) - 1 - open_[::-1].index(name) :]
        elif tag and not tag.startswith("/") and name not in htmltext.VOID:
            open_.append(name)
    return "\n".join(filter(None, (" ".join("".join(x).split()) for x in lines)))


def test_main_text_of_articles_matches_a_plain_walk():
    rng = random.Random(12)
    words = lambda k: " ".join(rng.choice(("of", "the &amp; a", "\n stone", "caf&eacute;", "run", "x&lt;y")) for _ in range(k))

    def element(depth):
        tag = rng.choice(("p", "div", "section", "ul", "b", "em", "a", "span", "h2", "nav", "aside", "button", "blockquote"))
        inner = "".join(words(rng.randrange(1, 9)) if depth == 0 or rng.random() < 0.5 else element(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(200):
        page = "<article>" + "".join(f"<p>{words(30)}</p>" + element(3) for _ in range(4)) + "</article>"
        assert htmltext.main_text(f"<body><nav>{words(5)}</nav>{page}<footer>{words(5)}</footer></body>") == plain_text(page)


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE % f"<article>{BODY}</article>"), (2, None, None), (2, None, None), (None, "v", "é𝄞")], "page_id long, url string, html string")
    df = df.withColumns({"text": F.lit("clash"), "n_chars": F.lit("x")})
    got = sorted(map(tuple, htmltext.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0), (None, "v", "é𝄞", 2)], key=str)
    assert htmltext.extract_pages(df.limit(0)).count() == 0


def crf_tables(spark, n=400):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(4, 12))) + "." for _ in range(rng.randrange(1, 6))]
        if bad := i % 4 == 0:
            lines = [lines[0], *(x.upper() + "!!" if i % 8 else " | ".join(x.split()) for x in [*lines, *lines])]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_crf_separates_held_out_documents(spark):
    docs, labels = crf_tables(spark)
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "x\n" * 5000), (902, "x\n" * 5000)], "doc_id long, text string")
    df = df.withColumns({"quality": F.lit(1), "score": F.lit("s")})
    got = crf.score_quality(df, labels).collect()
    told = [r for r in got if r["doc_id"] < 900]
    held = [r for r in told if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and len(got) == len(docs) + 4


def test_crf_edges(spark):
    docs, labels = crf_tables(spark, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["score"] for r in crf.score_quality(df, labels.limit(0)).collect()] == pytest.approx([0.5] * 20)
    assert crf.score_quality(df.limit(0), labels).count() == 0


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    emit, steps = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    states, moves, total = crf._recursions(emit, steps, np.ones((1, 4), bool))
    weights = {}
    for k in range(16):
        path = [(k >> t) & 1 for t in range(4)]
        weights[tuple(path)] = math.exp(sum(emit[0, t, s] for t, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
    z = sum(weights.values())
    assert total[0] == pytest.approx(math.log(z))
    for t in range(4):
        assert states[0, t, 1] == pytest.approx(sum(w for p, w in weights.items() if p[t]) / z)
    assert moves[0, 1] == pytest.approx(sum(w * sum(a == 0 and b == 1 for a, b in zip(p, p[1:], strict=False)) for p, w in weights.items()) / z)


def test_pairs_come_once_for_all_shared_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = {rep: set(rng.choice(80, 45, replace=False).tolist()) for rep in range(30)}  # each pair shares about 25 of 45
    rows = [(k, rep) for rep, own in sets.items() for k in own]
    led = lambda n: spark.createDataFrame([(k, k % n, rep, rep) for k, rep in rows], "key long, lead long, rep long, part long")
    point = overlap._points(np.zeros(45, np.uint64))  # the bound by groups leaves all
    points = spark.createDataFrame([(rep, 45, bytearray(point)) for rep in sets], "rep long, n long, point binary")
    least = int(overlap.pair_shown(45, 45))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
    for block, keys in ((overlap.BLOCK, overlap.ROWS), (8, overlap.ROWS), (overlap.BLOCK, 300)):
        monkeypatch.setattr(overlap, "BLOCK", block)
        monkeypatch.setattr(overlap, "ROWS", keys)
        for n in (1, 3):
            assert sorted(map(tuple, overlap._tree_pairs(led(n), points).collect())) == sorted(want)
            found = [(r["a"], r["b"]) for r in overlap._found_pairs(led(n), points).collect()]
            assert max(map(found.count, found)) <= n


def test_common_shingles_are_counted_in_all_documents(spark, monkeypatch):
    docs = [(i, f"one two three four five {'six seven eight ' * (i < 50)}and so on till {i}") for i in range(150)]
    want = {}
    for _, text in docs:
        for key in overlap.shingle_set(text).tolist():
            want[key] = want.get(key, 0) + 1
    slots = {}
    for key, n in want.items():
        if n >= overlap.SPARSE * overlap.COMMON:
            slots[key >> 42] = max(slots.get(key >> 42, 0), int(math.log2(n)))
    assert {5, 6, 7} >= set(slots.values()) > {5}
    for counted in (overlap.COUNTED, 200):  # in one range, and in many
        monkeypatch.setattr(overlap, "COUNTED", counted)
        got = overlap.common_slots(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == slots
    assert not overlap.common_slots(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).any()
