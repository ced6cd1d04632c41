"""Benchmark decontamination: suffix arrays over the training texts, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks_of, letter_words, map_rows, store

#: Words of a window.
WINDOW = 10

#: Bytes of text under one suffix array, and of test texts that tasks hold at a time.
CHUNK_BYTES = 32 << 20
BLOCK_BYTES = 16 << 20

#: Pairs of a test and a training suffix that are looked at together.
PAIRS = 1 << 20


@dataclass
class Tests:
    """The test items of a block: their words as codes, one item after another.

    Of every suffix at which a window begins, ``starts`` has the place and ``widths`` the words of
    its window; ``left`` has for every place the words up to the end of its item.
    """

    ids: list[str]
    vocabulary: dict[bytes, int]
    code: np.ndarray
    item: np.ndarray
    left: np.ndarray
    starts: np.ndarray
    widths: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Tests:
        ids, vocabulary, code, item, left, starts, widths = sorted({r[0] or "" for r in rows}), {}, [], [], [], [], []
        place = {x: k for k, x in enumerate(ids)}
        for name, text in rows:
            words, at = letter_words((text or "").encode()), len(code)
            code += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            item += [place[name or ""]] * len(words)
            left += range(len(words), 0, -1)
            width = min(window, len(words))
            begins = range(at, at + len(words) - width + 1) if words else ()
            starts += begins
            widths += [width] * len(begins)
        return cls(ids, vocabulary, *(np.array(x, np.int64) for x in (code, item, left, starts, widths)))


class SuffixArray:
    """The suffixes of a chunk of training texts that a window may begin, in order.

    Words are codes, -1 for those that no test item has. No match reaches over such a word or over
    the end of a text, so a suffix ends there, and stretches of known words that are shorter than
    the shortest window are left out. Order is by as many words as ``depth``, which is the longest
    item's length: prefixes of twice as many words are ranked in every round.
    """

    def __init__(self, codes: np.ndarray, shortest: int, depth: int):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= shortest
        begins, lengths = begins[long], (ends - begins)[long]
        offset = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(offset, lengths)
        self.at = np.repeat(begins, lengths) + within
        self.left = np.repeat(lengths, lengths) - within
        self.code = codes[self.at]
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        n = len(self.code)
        if not n:
            return np.zeros(0, np.int64)
        most, rank, k = min(depth, int(self.left.max())), self.code, 1
        while True:
            found, rank = np.unique(rank, return_inverse=True)
            if k >= most or len(found) == n:
                return np.argsort(rank, kind="stable")
            later = np.zeros(n, np.int64)
            far = np.flatnonzero(self.left > k)
            later[far] = rank[far + k] + 1
            rank, k = rank * (n + 1) + later, 2 * k

    def meet(self, tests: Tests, j: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words test suffixes j and training suffixes p begin with in common, at most so many."""
        limit = np.minimum(np.minimum(tests.left[j], self.left[p]), most)
        same, open_, depth = np.zeros(len(j), np.int64), np.flatnonzero(limit > 0), 0
        while len(open_):
            open_ = open_[tests.code[j[open_] + depth] == self.code[p[open_] + depth]]
            depth += 1
            same[open_] = depth
            open_ = open_[limit[open_] > depth]
        return same

    def bound(self, tests: Tests, j: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """Binary search for all test suffixes j at once, read to so many words: the first place whose
        suffix isn't smaller or, if after, is greater and doesn't begin with them."""
        low, high = np.zeros(len(j), np.int64), np.full(len(j), len(self.order))
        most = np.minimum(most, tests.left[j])
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            p, t = self.order[mid], j[open_]
            same = self.meet(tests, t, p, most[open_])
            whole, ended = same == most[open_], same == self.left[p]
            inside = ~(whole | ended)
            less = np.where(whole, after, ended)
            less[inside] = self.code[p[inside] + same[inside]] < tests.code[t[inside] + same[inside]]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low


def _spread(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places of ranges, in blocks: the range's number and the place."""
    size = last - first
    begin = 0
    while begin < len(size):
        end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), PAIRS, "right")))
        n = size[begin:end]
        which = np.repeat(np.arange(begin, end), n)
        yield which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
        begin = end


def _search(tests: Tests, texts: list[bytes | None], window: int) -> list[tuple[int, list, list]]:
    """For every text its words, the merged stretches of hit words and the longest match with each item."""
    get, split = tests.vocabulary.get, [letter_words(x) for x in texts]
    bounds = np.cumsum([0, *(len(x) + 1 for x in split)])
    codes = np.array([c for x in split for c in (*[get(w, -1) for w in x], -1)], np.int64)
    sizes, out = [len(x) for x in split], [([], []) for _ in split]
    del split
    j, width = tests.starts, tests.widths
    array = SuffixArray(codes, int(width.min(initial=window)), int(tests.left.max(initial=1)))
    if len(j) and len(array.order):
        first = array.bound(tests, j, width, False)
        # What a suffix meets at its place tells whether its window occurs at all.
        there = array.order[np.minimum(first, len(array.order) - 1)]
        met = array.meet(tests, j, there, width) == width
        j, width, first = j[met], width[met], first[met]
        last = array.bound(tests, j, width, True)
        _, one = np.unique(first * (window + 1) + width, return_index=True)  # equal windows are marked once
        marks = np.zeros(len(codes) + 1, np.int64)
        for which, place in _spread(first[one], last[one]):
            at = array.at[array.order[place]]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + width[one][which], -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(marks) > 0)).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            doc = int(np.searchsorted(bounds, a, "right")) - 1
            out[doc][0].append({"begin": a - int(bounds[doc]), "end": b - int(bounds[doc])})
        for doc, item, n, at, from_ in _longest(tests, array, j, first, last, bounds):
            out[doc][1].append({"item_id": tests.ids[item], "n_words": -n, "doc_word": at, "item_word": from_})
    return [(n, hits, matches) for n, (hits, matches) in zip(sizes, out, strict=True)]


def _longest(tests: Tests, array: SuffixArray, j, first, last, bounds) -> list[list]:
    """The longest match of every text and item that share a window: text, item, words as a negative number, where in the text, where in the item."""
    best = np.zeros((0, 5), np.int64)
    begin = np.flatnonzero(np.concatenate(([1], tests.left[:-1])) == 1)
    for which, place in _spread(first, last):
        t, p = j[which], array.order[place]
        # A match that can be lengthened to the left isn't the longest.
        inner = (t > 0) & (p > 0) & (tests.left[t - 1] == tests.left[t] + 1) & (array.left[p - 1] == array.left[p] + 1)
        inner[inner] = tests.code[t[inner] - 1] == array.code[p[inner] - 1]
        t, p = t[~inner], p[~inner]
        n = array.meet(tests, t, p, tests.left[t])
        doc = np.searchsorted(bounds, array.at[p], "right") - 1
        from_ = t - begin[np.searchsorted(begin, t, "right") - 1]
        best = np.concatenate((best, np.column_stack((doc, tests.item[t], -n, array.at[p] - bounds[doc], from_))))
        best = best[np.lexsort(best.T[::-1])]
        best = best[np.concatenate(([True], np.any(np.diff(best[:, :2], axis=0) != 0, axis=1)))[: len(best)]]
    return best.tolist()


_STRETCH = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
_MATCH = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("n_words", "doc_word", "item_word"))])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_STRETCH)), T.StructField("matches", T.ArrayType(_MATCH))]


def _searched(docs: DataFrame, tests: Broadcast, window: int) -> DataFrame:
    """The columns of docs but the last, which is the text, and what the search of a block finds: a map."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            keys, texts = [c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1].cast(pa.binary()).to_pylist()
            for a, b in chunks_of(texts, CHUNK_BYTES):
                yield list(zip(*(k[a:b] for k in keys), *zip(*_search(tests.value, texts[a:b], window), strict=True), strict=True))

    return map_rows(docs, made, [*docs.schema.fields[:-1], *_FOUND])


def _covered(hits: Column) -> Column:
    """The number of words in stretches, which may overlap."""
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda s, x: F.greatest(x["end"] - F.greatest(x["begin"], s["end"]), F.lit(0))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + more(s, x)).alias("n"))
    return F.aggregate(F.array_sort(hits), state, step, lambda s: s["n"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find every window of the test items in every document, and the longest verbatim matches.

    Words are lower-cased runs of letters and digits and of all characters beyond ASCII. A window
    is so many consecutive words of an item; an item of fewer words, but not none, is one window.
    Each task puts suffix arrays over its own documents, some MB of text under each, and searches
    them for every test suffix that begins a window, so documents are never shuffled. Test items
    are sent to the tasks in blocks of ``BLOCK_BYTES``; with more than one block, what the blocks
    find meets in a shuffle of the documents that were hit.

    Args:
        docs: an id and a text; other columns are ignored, whatever their names.
        benchmark: item_id, text; likewise.

    Returns:
        id_col, n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as text,
        of items with occurring windows), matches (per item the longest match: item_id, n_words,
        doc_word, item_word, which count words from 0; the first in the document if several). A row
        per input row, repeated ones too, each judged by its own text. Null and empty texts have no
        words. A text of any length is read whole. Items that repeat an id are one item, a null id
        is the empty text; without items, or items with words, nothing is hit. An empty table gives an empty one.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // -BLOCK_BYTES))
    text = F.col(text_col).cast("string").alias("text")
    spark, found = docs.sparkSession, None
    if blocks == 1:
        tests = spark.sparkContext.broadcast(Tests.of([tuple(r) for r in items.collect()], window))
        found = _searched(docs.select(F.col(id_col).alias("__id"), text), tests, window)
    else:
        rows = docs.select(F.col(id_col).alias("__id"), F.md5(F.coalesce(text, F.lit(""))).alias("__key"), text)
        parts = []
        for k in range(blocks):
            block = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
            tests = spark.sparkContext.broadcast(Tests.of([tuple(r) for r in block], window))
            made = _searched(rows, tests, window)
            parts.append(store(made if k == 0 else made.filter("size(hits) > 0"), "leaks"))
            tests.destroy()
        first, hit = parts[0], parts[0].filter("size(hits) > 0")
        for part in parts[1:]:
            hit = hit.unionByName(part)
        # Rows that repeat a text bring the same finds: one of each block is enough.
        longest = F.array_sort(F.flatten(F.collect_set("matches")))
        hit = hit.groupBy("__key").agg(F.flatten(F.collect_set("hits")).alias("hits"), longest.alias("matches"))
        none = [F.coalesce(F.col(f"b.{f.name}"), F.array().cast(f.dataType)).alias(f.name) for f in _FOUND[1:]]
        found = first.alias("a").join(hit.alias("b"), F.col("a.__key") == F.col("b.__key"), "left").select("a.__id", "a.n_words", *none)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(F.col("__id").alias(id_col), "n_words", _covered(F.col("hits")).alias("n_hit"), ids.alias("items"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the documents in which a window of an item occurs; the rest keep all their columns.

    Rows with the texts of removed ones go with them, whatever their ids. Odd rows as in
    :func:`find_leaks`: texts without words stay.
    """
    rows = docs.select(F.col(text_col).alias("text")).withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    found = find_leaks(rows, benchmark, window=window, id_col="key")
    gone = store(found.filter("n_hit > 0").select(F.col("key").alias("__skein_key")).distinct(), "leaked")
    tagged = docs.withColumn("__skein_own", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return tagged.join(gone, F.col("__skein_own") == F.col("__skein_key"), "left_anti").drop("__skein_own")
