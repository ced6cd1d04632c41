"""Suffix arrays, dominance counts and treaps against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import dominance, suffixes, treaps

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_leaks(docs, items, window):
    out = []
    for doc, text in docs:
        own, hit, ids, longest = words(text), set(), set(), {}
        for item, other in items:
            test = words(other)
            width = min(window, len(test))
            for j in range(len(test) - width + 1 if test else 0):
                for p in range(len(own) - width + 1):
                    if own[p : p + width] == test[j : j + width]:
                        hit.update(range(p, p + width))
                        name = "" if item is None else str(item)
                        ids.add(name)
                        n = width
                        while p + n < len(own) and j + n < len(test) and own[p + n] == test[j + n]:
                            n += 1
                        longest[name] = min(longest.get(name, (0, 0)), (-n, p))
        out.append((doc, len(own), len(hit), sorted(ids), sorted((i, -n, p) for i, (n, p) in longest.items())))
    return sorted(out, key=str)


def told_leaks(rows):
    return sorted(((r[0], r[1], r[2], r[3], sorted((m.item_id, m.n_words, m.doc_word) for m in r[4])) for r in rows), key=str)


def leak_tables(seed):
    rng = random.Random(seed)
    text = lambda n, of="abcé": " ".join(rng.choice(of) for _ in range(n))
    items = [(k, text(rng.choice((1, 2, 4, 9)), "abcéQ")) for k in range(8)] + [(3, text(5)), (None, text(4)), (20, None), (21, " .,"), (22, text(6)), (22, text(6))]
    docs = [(k, text(rng.choice((0, 1, 3, 20, 200)), "abcéXY")) for k in range(30)]
    docs += [(90, None), (91, ""), (92, "A.B;c\x00a—b"), (3, docs[3][1]), (None, text(40)), (93, "a " * 300), (94, items[2][1])]
    return docs, items


@pytest.mark.parametrize("window", [3, 10])
@pytest.mark.parametrize("sizes", [(32 << 20, 16 << 20, 1 << 20), (200, 20, 7)])
def test_leaks_are_those_of_plain_loops(spark, monkeypatch, window, sizes):
    for name, size in zip(("CHUNK_BYTES", "BLOCK_BYTES", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(suffixes, name, size)
    docs, items = leak_tables(window)
    df = spark.createDataFrame(docs, DOCS).withColumns({"n_words": F.lit(1), "hits": F.lit("x"), "item_id": F.lit(2)})
    extra = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(0))
    got = suffixes.find_leaks(df, extra, window=window).collect()
    assert told_leaks(got) == plain_leaks(docs, items, window)
    clean = suffixes.decontaminate(df, extra, window=window)
    assert clean.columns == df.columns
    want = [d for d, x in zip(docs, docs, strict=True) if not plain_leaks([x], items, window)[0][2]]
    assert sorted(map(str, ((r[0], r[1]) for r in clean.collect()))) == sorted(map(str, want))


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    for depth in (1, 3, 50):
        codes = rng.integers(-1, 3, 400)
        array = suffixes.SuffixArray(codes, 2, depth)
        said = [array.code[p : p + min(depth, array.left[p])].tolist() for p in array.order]
        assert said == sorted(said) and sorted(array.order) == list(range(len(array.code)))


def test_leaks_of_a_very_long_text_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(40))
    text = "pad " * 300_000 + item + " pad" * 5
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 w3")], DOCS)
    items = spark.createDataFrame([(7, item)], ITEMS)
    got = {r.doc_id: r for r in suffixes.find_leaks(docs, items).collect()}
    assert got[1].n_hit == 40 and got[1].matches[0].doc_word == 300_000 and got[1].matches[0].n_words == 40
    assert got[2].n_hit == 0 and got[2].matches == [] and got[2].items == []
    none = spark.createDataFrame([], ITEMS)
    assert {r.n_hit for r in suffixes.find_leaks(docs, none).collect()} == {0}
    assert suffixes.find_leaks(docs.limit(0), items).count() == 0 and suffixes.decontaminate(docs, none).count() == 2


def plain_above(rows):
    out = []
    for slot, level, _ in rows:
        over = None if slot is None or level is None else [w or 0 for s, v, w in rows if s is not None and v is not None and s <= slot and v > level]
        out.append((slot, level, over and len(over) or (None if over is None else 0), None if over is None else sum(over)))
    return sorted(out, key=str)


@pytest.mark.parametrize("load", [1, 4, 64])
def test_counts_above_are_those_of_plain_loops(spark, load, monkeypatch):
    monkeypatch.setattr(dominance, "SWEPT", 50)
    rng = random.Random(load)
    draw = lambda n: rng.choice((0, 5)) if rng.random() < 0.4 else rng.randrange(-n, n)
    rows = [(draw(30), float(draw(30)) / 2, rng.choice((1, 2, 3, None))) for _ in range(500)] + [(None, 1.0, 1), (1, None, 1), (None, None, None)] * 2
    df = spark.createDataFrame(rows, "slot long, level double, w long").withColumns({"row": F.lit(1), "col": F.lit(2), "n": F.lit(3)})
    made = dominance.count_above(df, weight="w", load=load)
    assert made.columns == [*df.columns, "n_above", "weight_above"]
    assert sorted(((r.slot, r.level, r.n_above, r.weight_above) for r in made.collect()), key=str) == plain_above(rows)


def test_counts_above_of_few_rows(spark):
    kind = "slot long, level long"
    assert dominance.count_above(spark.createDataFrame([], kind)).count() == 0
    one = dominance.count_above(spark.createDataFrame([(1, 1)] * 50, kind)).collect()
    assert {(r.n_above, r.weight_above) for r in one} == {(0, 0)} and len(one) == 50
    hot = [(1, k) for k in range(300)] + [(k, 9) for k in range(300)]  # one slot, one level of half of all points
    got = dominance.count_above(spark.createDataFrame(hot, kind), load=2).collect()
    assert sorted(((r.slot, r.level, r.n_above, r.weight_above) for r in got), key=str) == plain_above([(*x, 1) for x in hot])
    with pytest.raises(ValueError, match="n_above"):
        dominance.count_above(spark.createDataFrame([(1, 1, 1)], "slot long, level long, n_above long"))


def plain_ranks(docs, items, k):
    split = [(doc, words(text)) for doc, text in docs]
    split = [(doc, Counter(w), len(w)) for doc, w in split]
    n_docs, n_terms = sum(n > 0 for *_, n in split), sum(n for *_, n in split)
    df = Counter(w for _, c, _ in split for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c, n in split:
            m = n and 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("postings", "pairs"), [(1 << 19, 500_000), (60, 500_000), (100, 8)])
def test_ranks_are_those_of_plain_loops(spark, monkeypatch, postings, pairs):
    monkeypatch.setattr(treaps, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(treaps, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(treaps, "PILOT", 4)
    rng = random.Random(pairs)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 40}" for _ in range(n))
    docs = [(k, text(rng.choice((0, 1, 5, 30)))) for k in range(120)]
    docs += [(5, docs[5][1]), (6, "w3 w3"), (200, None), (201, "W7-w8 É é"), (202, "w9 " * 3000)] + [(300 + k, "w1 w2 w3") for k in range(40)]
    items = [(k, text(6)) for k in range(6)] + [(2, "w1 w3"), (7, None), (8, "unseen"), (9, "É é w7"), (None, "w2 w3")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"id": F.lit(1), "n": F.lit(2), "item_id": F.lit(3)})
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(0))
    got = treaps.rank_documents(df, asked, 12).collect()
    assert sorted(map(tuple, got), key=str) == plain_ranks(docs, items, 12)


def test_ranks_of_nothing_and_null_ids(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, "c")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert [r.doc_id for r in treaps.rank_documents(docs, items).orderBy("rank").collect()] == [1, None]
    assert treaps.rank_documents(docs.limit(0), items).count() == 0
    assert treaps.rank_documents(docs, items.limit(0)).count() == 0


def test_treaps_are_heaps_in_order_and_prune():
    rng = np.random.default_rng(3)
    term, doc = np.divmod(np.arange(20_000), 2000)
    value = np.where(rng.random(20_000) < 0.5, 7, rng.pareto(1.0, 20_000) * 100).astype(np.int64) + 1
    made = treaps.Treaps.of(term, doc, value)

    def walk(node):
        if node < 0:
            return []
        for child in (made.left[node], made.right[node]):
            assert child < 0 or made.impact[child] <= made.impact[node]
        return [*walk(made.left[node]), made.doc[node], *walk(made.right[node])]

    for root in made.roots.values():
        assert walk(root) == list(range(2000))
    docs, scores, seen = made.best([0, 3, 5], 10, 0)
    full = value.reshape(10, 2000)[[0, 3, 5]].sum(0)
    tenth = np.sort(full)[-10]
    assert sorted(docs) == np.flatnonzero(full >= tenth).tolist() and scores.tolist() == full[docs].tolist()
    assert seen < 400
