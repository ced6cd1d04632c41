"""Retrieval corpora, exact vector search and context budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..sources.scratch import store


def chunk_rows(docs: DataFrame, *, size: int = 600, overlap: int = 100, least: int = 40) -> DataFrame:
    """doc_id, pos, chunk: a row per chunk of text."""
    made = tx.chunks(F.col("text"), size=size, overlap=overlap, least=least)
    return docs.select("doc_id", F.posexplode(made).alias("pos", "chunk"))


def numbered(rows: DataFrame, *order: Column | str, weight: str | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with a global running index from 0 in the given order, which must be total.

    Rows are sorted into ranges, numbered there and written once, so that counting and numbering
    read the same ranges. A range's first number is the sum of those before; no task sees more
    than its range and the counts of the ranges. With a weight, a column of numbers, ``before``
    is the sum of the weights of all earlier rows. With ``made``, a function that turns each row
    into rows in place, these are numbered; costly ones are so made once, after the sort.
    """
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = store((made(ranged) if made else ranged).withColumn("__at", at), "ranges")
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    ranged = ranged.withColumn("__part", part)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *([F.sum(weight).alias("__w")] if weight else []))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = {"__n": "__first"} | ({"__w": "__sum"} if weight else {})
    firsts = sizes.select("__part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(v) for k, v in sums.items()])
    out = ranged.join(F.broadcast(firsts), "__part").withColumn("index", F.col("__first") + nth)
    if weight:
        within = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("__sum") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return out.drop("__part", "__at", *sums.values())


def build_corpus(docs: DataFrame, *, prefix: str, size: int = 600, cap: int | None = None) -> DataFrame:
    """index, id, doc_id, text: chunks with their ids, the first ``cap`` of them if it is given."""
    rows = numbered(docs.select("doc_id", "text"), "doc_id", made=lambda ranged: chunk_rows(ranged, size=size))
    if cap is not None:
        rows = rows.filter(F.col("index") < cap)
    return rows.select("index", tx.passage_id(prefix, F.col("chunk"), F.col("index")).alias("id"), "doc_id", F.col("chunk").alias("text"))


def explanation_corpus(questions: DataFrame, banned: DataFrame, *, prefix: str = "parity") -> DataFrame:
    """Chunks of explanations of questions whose hash isn't banned, without answer keys."""
    rows = questions.filter("explanation is not null").join(banned.select("hash").distinct(), "hash", "left_anti")
    rows = rows.select(F.col("id").alias("doc_id"), tx.strip_answer_key(F.col("explanation")).alias("text"))
    return build_corpus(rows.filter("text != ''"), prefix=prefix)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("doc_id").alias("source_documents"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"),
        F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean_chars"),
    )


#: Queries and vectors that meet in one task, and those of them that are multiplied at once: a product
#: of doubles takes 4 MB.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
QUERY_STRIP, VECTOR_STRIP = 256, 2048


def _first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest scores of each row, by id on ties."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], scores[kept]


def _best(query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of some vectors for some queries; scores go to 12 decimals, so that equal vectors tie.

    Strips of queries meet strips of vectors, so that memory doesn't grow with either. From one
    strip of vectors to the next only k rows a query are kept.
    """
    best: list = [None] * -(-len(queries) // QUERY_STRIP)
    for start in range(0, len(vectors), VECTOR_STRIP):
        strip, own = _matrix(vectors.slice(start, VECTOR_STRIP)), vec_ids[start : start + VECTOR_STRIP]
        for i in range(len(best)):
            scores = queries[i * QUERY_STRIP : (i + 1) * QUERY_STRIP] @ strip.T
            np.round(scores, 12, out=scores)
            n, m = scores.shape
            if m > k:  # what ties with the k-th stays, for the ids to decide
                row, col = np.nonzero(scores >= np.partition(scores, m - k, axis=1)[:, m - k, None])
            else:
                row, col = np.nonzero(np.ones((n, m), bool))
            found = row, own[col], scores[row, col]
            if best[i] is not None:
                found = tuple(map(np.concatenate, zip(best[i], found, strict=True)))
            best[i] = _first(*found, k)
    for i, found in enumerate(best):
        if found is not None:
            row, ids, scores = found
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[i * QUERY_STRIP + row]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, least: float | None = None) -> DataFrame:
    """The k vectors of greatest inner product for each query, by id on ties.

    Blocks of queries meet blocks of vectors in matrix products, each of which hands on k rows a
    query. Up to QUERY_BLOCK queries go to every task; more are dealt out in blocks with copies
    of the vectors, so that no task holds all queries. A floor of scores applies after the cut.

    Args:
        queries: query_id, query; vectors: vec_id, embedding. Null vectors are left out.

    Returns:
        query_id, rank, vec_id, score.
    """
    queries = queries.select("query_id", "query").filter("query is not null")
    vectors = vectors.select("vec_id", "embedding").filter("embedding is not null")
    kinds = [queries.schema["query_id"], vectors.schema["vec_id"]]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("score", T.DoubleType())])
    n = queries.count()
    if n <= QUERY_BLOCK:
        held = queries.toArrow()
        ids, matrix = held["query_id"].combine_chunks().to_numpy(zero_copy_only=False), _matrix(held["query"].combine_chunks())

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from _best(ids, matrix, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), k)

        best = vectors.mapInArrow(scored, schema)
    else:
        across, down = -(-n // QUERY_BLOCK), max(1, -(-vectors.count() // VECTOR_BLOCK))
        dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
        copies = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = queries.select("query_id", "query", dealt("query_id", across).alias("q"), copies(down).alias("v"))
        right = vectors.select("vec_id", "embedding", dealt("vec_id", down).alias("v"), copies(across).alias("q"))

        def met(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return pa.Table.from_batches([], schema=to_arrow_schema(schema))
            values = lambda t, c: t[c].combine_chunks()
            ids, others = (values(t, c).to_numpy(zero_copy_only=False) for t, c in ((one, "query_id"), (two, "vec_id")))
            return pa.Table.from_batches(_best(ids, _matrix(values(one, "query")), others, values(two, "embedding"), k), to_arrow_schema(schema))

        best = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(met, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    if least is not None:
        out = out.filter(F.coalesce("score", F.lit(0.0)) >= least)
    return out.select("query_id", "rank", "vec_id", "score")


def within_budget(passages: DataFrame, max_chars: int) -> DataFrame:
    """Whole passages (query_id, rank, text) by rank until the first that would overflow; the first always."""
    seen = F.sum(F.length("text")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    rows = passages.withColumns({"cum_chars": seen, "place": place})
    return rows.filter((F.col("place") == 1) | (F.col("cum_chars") <= max_chars)).drop("place")


#: Cells into which vectors are clustered at most, sampled vectors per cell that the centres are made
#: of, and rounds of moving them.
CELLS, PER_CELL, MOVES = 1024, 32, 6

#: What rounding may add to a score.
SLACK = 1e-9


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a bounded sample, by moving evenly drawn ones to the means of what is nearest."""
    if not len(sample):
        return np.zeros((0, 0))
    centres = np.unique(sample[:: max(1, len(sample) // cells)], axis=0)[:cells]
    for _ in range(MOVES):
        near = _nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the distance to it, a strip of vectors at a time."""
    half = (centres**2).sum(1) / 2
    cell = np.concatenate([(vectors[i : i + VECTOR_STRIP] @ centres.T - half).argmax(1) for i in range(0, max(len(vectors), 1), VECTOR_STRIP)])
    return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(1))


class CellIndex:
    """Vectors clustered around centres, with the radius of every cluster, for exact searches that skip clusters.

    The centres come from a bounded sample in the order of hashes; every vector is indexed, with its
    cell, in a stored table. A score of a query and a vector of a cell is at most the query's score of
    the centre and its length times the cell's radius.
    """

    def __init__(self, vectors: DataFrame, *, cells: int | None = None):
        vectors = vectors.select("vec_id", "embedding").filter("embedding is not null")
        self.n = vectors.count()
        wanted = max(1, min(CELLS, int(self.n**0.5))) if cells is None else cells
        some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PER_CELL * wanted).toArrow()["embedding"].combine_chunks()
        self.centres = centres = _centres(_matrix(some), wanted)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, far = _nearest(_matrix(batch.column(1)), centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])
        self.vectors = store(vectors.mapInArrow(placed, schema) if self.n else vectors.sparkSession.createDataFrame([], schema), "cells")
        self.size, self.radius = np.zeros(max(len(centres), 1), np.int64), np.zeros(max(len(centres), 1))
        for cell, size, radius in self.vectors.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect():
            self.size[cell], self.radius[cell] = size, radius

    def _asked(self, queries: DataFrame, k: int, again: bool) -> DataFrame:
        """query_id, query, cell: the cells to search for each query.

        First those of the best centres that hold k vectors. Then, of the others, those whose bound
        reaches the floor that the first have set.
        """
        centres, size, radius = self.centres, self.size, self.radius

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                if not centres.size:
                    continue
                for start in range(0, whole.num_rows, QUERY_STRIP):
                    batch = whole.slice(start, QUERY_STRIP)
                    matrix = _matrix(batch.column(1))
                    scores = matrix @ centres.T
                    order = np.argsort(-scores, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    first = np.zeros(scores.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    if again:
                        floor = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                        bound = scores + np.sqrt((matrix**2).sum(1))[:, None] * radius
                        first = ~first & (bound >= floor - SLACK)
                    row, cell = np.nonzero(first & (size > 0))
                    picked = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(cell)], names=["query_id", "query", "cell"])

        schema = T.StructType([queries.schema["query_id"], queries.schema["query"], T.StructField("cell", T.LongType())])
        return queries.mapInArrow(told, schema)

    def _met(self, asked: DataFrame, n_queries: int, k: int) -> DataFrame:
        """The k best vectors of every asked pair of query and cell: blocks of queries meet blocks of a cell's vectors."""
        parts = F.array(*[F.lit(int(-(-s // VECTOR_BLOCK)) or 1) for s in self.size])
        across = max(1, -(-n_queries // QUERY_BLOCK))
        dealt = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
        copies = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
        of_cell = F.get(parts, F.col("cell").cast("int"))
        left = asked.select("query_id", "query", "cell", dealt("query_id", F.lit(across)).alias("q"), copies(of_cell).alias("v"))
        right = self.vectors.select("vec_id", "embedding", "cell", dealt("vec_id", of_cell).alias("v"), copies(F.lit(across)).alias("q"))
        kinds = [asked.schema["query_id"], self.vectors.schema["vec_id"]]
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("score", T.DoubleType())])

        def product(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return pa.Table.from_batches([], schema=to_arrow_schema(schema))
            values = lambda t, c: t[c].combine_chunks()
            ids, others = (values(t, c).to_numpy(zero_copy_only=False) for t, c in ((one, "query_id"), (two, "vec_id")))
            return pa.Table.from_batches(_best(ids, _matrix(values(one, "query")), others, values(two, "embedding"), k), to_arrow_schema(schema))

        return left.groupBy("cell", "q", "v").cogroup(right.groupBy("cell", "q", "v")).applyInArrow(product, schema)

    def top_k(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The exact k vectors of greatest inner product for each query, and how much was skipped.

        Args:
            queries: query_id, query. Null queries are left out.

        Returns:
            query_id, rank, vec_id, score; and a row of n_queries, n_vectors, n_products and skipped, the
            share of all products that no task computed.
        """
        queries = queries.select("query_id", "query").filter("query is not null")
        n = queries.count()
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        best = lambda rows: rows.withColumn("rank", rank).filter(F.col("rank") <= k)
        first = self._asked(queries, k, again=False)
        top = store(best(self._met(first, n, k)), "first")
        floors = top.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        met = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        more = store(self._asked(met, k, again=True), "more")
        out = best(top.drop("rank").unionByName(self._met(more, n, k)))
        sizes = F.array(*map(F.lit, self.size.tolist()))
        pairs = first.select("cell").unionByName(more.select("cell")).agg(F.coalesce(F.sum(F.get(sizes, F.col("cell").cast("int"))), F.lit(0)).alias("n_products"))
        whole = F.lit(float(n) * self.n)
        told = pairs.select(F.lit(n).cast("long").alias("n_queries"), F.lit(self.n).cast("long").alias("n_vectors"), "n_products", (1 - F.coalesce(F.try_divide("n_products", whole), F.lit(1.0))).alias("skipped"))
        return out.select("query_id", "rank", "vec_id", "score"), told
