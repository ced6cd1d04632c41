"""Ranked lexical search: inverted treaps, traversed together and pruned by summed maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from .common import forget, letter_words, map_rows, scope, store

#: Pairs of an item and a term that tasks hold at a time, postings of a shard on average, and one in
#: how many shards is searched first, for scores that the rest must reach.
BLOCK_PAIRS = 500_000
SHARD_POSTINGS = 1 << 19
PILOT = 16

#: Subtrees that are split together.
STEP = 128


@dataclass
class Treaps:
    """The treaps of a shard: by document in order, by impact as heaps.

    Node p is a posting: ``doc`` its document's place in the shard, ``impact`` what its term adds to
    the document's score, ``left`` and ``right`` its children or -1. ``roots`` has each term's root.
    The impact of a node is the greatest of its subtree; equal ones stand by a mixed-up number, so
    that many equal impacts make no chain.
    """

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: dict[int, int]

    @classmethod
    def of(cls, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> Treaps:
        """From postings with an impact above 0; a term has a document once."""
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        mixed = np.argsort(np.argsort(doc * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), kind="stable"))
        heap = np.empty(len(doc), np.int64)
        heap[np.lexsort((mixed, impact))] = np.arange(len(doc))  # one number for each node: no two are equal
        n = len(doc)
        left, right, roots, stack, before = [-1] * n, [-1] * n, {}, [], None
        rank = heap.tolist()
        for at, own in enumerate(term.tolist()):
            if own != before:
                if stack:
                    roots[before] = stack[0]
                stack, before = [], own
            under = -1
            while stack and rank[stack[-1]] < rank[at]:
                under = stack.pop()
            left[at] = under
            if stack:
                right[stack[-1]] = at
            stack.append(at)
        if stack:
            roots[before] = stack[0]
        # A last node stands for none: it lies beyond all documents and adds nothing.
        return cls(np.append(doc, np.iinfo(np.int64).max), np.append(impact, 0), np.array([*left, -1], np.int64), np.array([*right, -1], np.int64), roots)

    def between(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of each subtree as cut to the documents between low and high, both exclusive; -1 if none."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            doc = self.doc[at]
            early, late = doc <= low[open_], doc >= high[open_]
            open_, at, early = open_[early | late], at[early | late], early[early | late]
            node[open_] = down = np.where(early, self.right[at], self.left[at])
            open_ = open_[down >= 0]
        return node

    def best(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents of the k highest scores, ties with the k-th included, that reach the least; their scores; how many were scored.

        Each step takes the subtrees (stretches of documents with a node per term) of the highest
        bounds, scores the document of the greatest impact in each and splits there. A stretch goes
        when the sum of its nodes' impacts is under the k-th score found so far.
        """
        roots = np.array([self.roots[t] for t in terms if t in self.roots], np.int64)
        docs, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        low, high, nodes = np.array([-1]), np.array([np.iinfo(np.int64).max]), roots[None, :]
        bound = self.impact[nodes].sum(1)
        while len(bound) and nodes.shape[1]:
            some = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            now, at_low, at_high = nodes[some], low[some], high[some]
            doc = self.doc[now[np.arange(len(some)), self.impact[now].argmax(1)]]
            flat = lambda x: np.repeat(x, now.shape[1])
            own = self.between(now.ravel(), flat(doc - 1), flat(doc + 1)).reshape(now.shape)
            seen += len(some)
            docs, scores = np.append(docs, doc), np.append(scores, self.impact[own].sum(1))
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= least], scores[scores >= least]
            halves = [self.between(now.ravel(), flat(a), flat(b)).reshape(now.shape) for a, b in ((at_low, doc), (doc, at_high))]
            keep = np.ones(len(bound), bool)
            keep[some] = False
            low, high = np.concatenate((low[keep], at_low, doc)), np.concatenate((high[keep], doc, at_high))
            nodes = np.concatenate((nodes[keep], *halves))
            bound = np.concatenate((bound[keep], *(self.impact[h].sum(1) for h in halves)))
            left = bound >= max(least, 1)
            low, high, nodes, bound = low[left], high[left], nodes[left], bound[left]
        return docs[scores >= max(least, 1)], scores[scores >= max(least, 1)], seen


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """id, n (terms with repeats), terms (numbers of those in the vocabulary), times, deal (a number of its own): a row per row.

    Args:
        docs: id, text.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        number, deal = vocabulary.value.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = letter_words(text.as_py())
                known = Counter(k for w in words if (k := number(w)) is not None)
                rows.append((doc, len(words), list(known), list(known.values()), deal))
                deal += 1
                if len(rows) == 1000:
                    yield rows
                    rows = []
            yield rows

    numbers = T.ArrayType(T.LongType())
    fields = [docs.schema["id"], *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("terms", numbers), ("times", numbers), ("deal", T.LongType())))]
    return map_rows(docs, made, fields)


def impacts(weight: np.ndarray, times: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term adds to a score: its weight by its saturated number of times in a document of n terms."""
    length = 50 + (50 * n * documents) // max(terms, 1)
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * length))


def _searching(items: list[tuple], weights: np.ndarray, floors: dict, documents: int, terms: int, k: int, shared, schema):
    """A function that puts the postings of a shard into treaps and finds the best documents for each of the items."""
    held = shared((items, weights, floors))

    def search(table: pa.Table) -> pa.Table:
        items, weights, floors = held.value
        ids = table["id"].combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.diff(table["terms"].combine_chunks().offsets.to_numpy())
        term, times = (table[c].combine_chunks().flatten().to_numpy() for c in ("terms", "times"))
        value = impacts(weights[term], times, np.repeat(table["n"].to_numpy(), sizes), documents, terms)
        some = value > 0
        treaps = Treaps.of(term[some], np.repeat(place, sizes)[some], value[some])
        found = []
        for item, own in items:
            docs, scores, _ = treaps.best(own, k, floors.get(item, 0))
            first = np.lexsort((docs, -scores))[:k]
            found.append((item, order[docs[first]], scores[first]))
        of = [pa.array([item for item, docs, _ in found for _ in docs.tolist()], schema.field(0).type)]
        rows = np.concatenate([np.zeros(0, np.int64), *(docs for _, docs, _ in found)])
        of += [ids.take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *(scores for *_, scores in found)]))]
        return pa.Table.from_arrays(of, schema=schema)

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k documents of the highest scores for each item, exactly.

    Terms are lower-cased runs of letters and digits and of all characters beyond ASCII. Texts are
    read once, where they lie, into postings of the items' terms. These are dealt out in shards of
    bounded size, by a number and not by term, so that a frequent term spreads over all; in a
    shard each term's postings become a treap. For an item the treaps of its terms are traversed
    together. One shard in ``PILOT`` is searched first; the k-th score found there is a floor for
    the others. Items, a stated set of queries, are held by tasks in blocks of ``BLOCK_PAIRS`` pairs
    of item and term; with several blocks the texts are read for each.

    Args:
        docs: an id (a whole number) and a text; other columns are ignored, whatever their names.
        items: item_id, text; likewise.

    Returns:
        item_id, rank (from 1), doc_id, score: documents with a score above 0, equal scores by
        ascending id, null ids last. Each row of docs is a document, so rows that repeat an id rank
        apart. Rows of one item_id are one item, of all their terms; so are those of a null id. Null
        and empty texts have no terms. Texts of any length are read whole. Without documents or
        terms there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = lambda batches: ([(i, w.decode()) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in set(letter_words((t or "").encode()))] for b in batches)
    kind = items.schema["item_id"]
    asked = items.select("item_id", F.col("text").cast("string"))
    asked = store(map_rows(asked, words, [kind, T.StructField("term", T.StringType())]).distinct(), "asked")
    blocks = max(1, -(-asked.count() // BLOCK_PAIRS))
    out = T.StructType([T.StructField("item_id", kind.dataType), T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])
    arrow, tops = to_arrow_schema(out), []
    for block in range(blocks):
        with scope() as kept:
            own: dict = {}
            vocabulary: dict[bytes, int] = {}
            for item, term in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").collect():
                own.setdefault(item, []).append(vocabulary.setdefault(term.encode(), len(vocabulary)))
            postings = store(_postings(rows, spark.sparkContext.broadcast(vocabulary)), "postings")
            documents, terms, pairs = postings.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
            weights = np.zeros(len(vocabulary), np.int64)
            for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
            shards = max(1, -(-pairs // SHARD_POSTINGS))
            dealt = postings.filter("size(terms) > 0").withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
            search = lambda floors: _searching(list(own.items()), weights, floors, documents, terms, k, spark.sparkContext.broadcast, arrow)  # noqa: B023, E731
            first, floors = max(1, shards // PILOT), {}
            top = store(_best(dealt.filter(F.col("shard") < first).groupBy("shard").applyInArrow(search({}), out), k), "pilot")
            if first < shards:
                floors = {r[0]: r[1] for r in top.filter(F.col("rank") == k).select("item_id", "score").collect()}
                rest = dealt.filter(F.col("shard") >= first).groupBy("shard").applyInArrow(search(floors), out)
                top = store(_best(top.drop("rank").unionByName(rest), k), "top")
            kept.append(top)
            tops.append(top)
    forget(asked)
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found.select("item_id", "rank", "doc_id", "score")
