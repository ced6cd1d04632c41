"""Pack token sequences into fixed capacities by vector best-fit."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import batches_of, map_rows, store

#: The id that ends a document.
END = 0

#: Chunks of text whose ids a worker remembers, at most.
MEMORY = 400_000

#: Texts, and bytes of them, that a task tokenizes at once.
BATCH, BATCH_BYTES = 1000, 4 << 20

#: White space after a space: there chunks of text depend on one another.
_RUN = re.compile(r" \s")


class _Chunks(dict):
    """Ids of chunks as bytes; with a lead, of the chunk after that lead."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        self[chunk] = found = np.array(self.encode(self.lead + chunk), "<u4").tobytes()
        return found


class TokenIds:
    """Ids of texts by a byte-level BPE vocabulary given as ranks.

    The vocabulary's pattern never lets a token reach over a single space that stands between
    other characters except as its first character. So a text can be cut before such spaces
    and the ids of each chunk remembered. A text in which white space follows a space is
    encoded as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = bpe.encode_ordinary
        self.first, self.later = _Chunks(self.encode, ""), _Chunks(self.encode, " ")

    def bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _RUN.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *later = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, later))


@lru_cache(1)
def _token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_pieces(docs: DataFrame, *, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Tokenize every whole text and cut what exceeds the capacity.

    The ids are those of the library's byte_bpe_50k.json without special tokens, with marks of
    special tokens in a text taken as text; they are made from the same vocabulary's other file,
    and a test holds both forms equal.

    Returns:
        doc_id, piece, start, length, ids_crc32, part, nth: a row per piece. A document longer
        than the capacity has pieces of the capacity, but for the first, which has the rest.
        nth counts the pieces of that length within the input partition called part.
    """

    vocabulary = vocabulary or default_vocabulary()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        ids, part = _token_ids(vocabulary), TaskContext.get().partitionId()
        end, seen = np.array([END], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = ids.bytes(text or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            yield rows

    fields = "piece int, start long, length long, ids_crc32 long, part int, nth long"
    return map_rows(docs.select("doc_id", "text"), made, [docs.schema["doc_id"], *T._parse_datatype_string(fields)])


def vector_best_fit(
    counts: dict[int, int], *, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], score: str = "dot"
) -> list[tuple[int, int, int, int, int]]:
    """Pack items, given by how many there are of each length, into as few bins as best-fit does.

    An item of length n needs the vector (n tokens, 1 document, n * n attention cost) of a bin's
    capacities. Longer items go first. An item goes to the open bin that has room in every
    dimension and of these has the largest weighted dot product of its need and the bin's load,
    both in parts of the capacities (``dot``), or the smallest weighted norm of what would
    remain (``norm``); on ties the fuller bin. Bins of equal load are kept as one range, so
    the work depends on the number of lengths, not of items.

    Returns:
        Placements (length, first item, items, first bin, offset): item first + i of that length
        goes to bin first + i at the offset.
    """
    full = np.array([capacity, max_docs, max_cost], float)
    scale = np.asarray(weights, float)
    bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # load -> ranges of bins
    placed, opened = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        todo, taken = counts[length], 0
        if (need > full).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacities")
        loads = np.array(list(bins), float).reshape(-1, 3)
        room = loads + need <= full if len(loads) else np.zeros((0, 3), bool)
        fits = [tuple(map(int, load)) for load in loads[room.all(1)]]

        def rank(load: tuple[int, int, int], need=need) -> tuple[float, int]:
            held = np.array(load, float)
            if score == "norm":
                left = (full - held - need) / full
                return -float((scale * left * left).sum()), load[0]
            return float((scale * (held / full) * (need / full)).sum()), load[0]

        order = sorted(((rank(x), x) for x in fits), reverse=True)
        while todo:
            if order:
                _, load = order.pop(0)
                ranges = bins.pop(load)
            else:
                load, ranges = (0, 0, 0), [(opened, todo)]
                opened += todo
            after = (load[0] + length, load[1] + 1, load[2] + length * length)
            for start, n in ranges:
                put = min(n, todo)
                if put:
                    placed.append((length, taken, put, start, load[0]))
                    bins.setdefault(after, []).append((start, put))
                    todo, taken = todo - put, taken + put
                if put < n:
                    bins.setdefault(load, []).append((start + put, n - put))
            if todo and after in bins and after[0] + length <= capacity and after[1] < max_docs and after[2] + length * length <= max_cost:
                order = sorted([*((r, x) for r, x in order if x != after), (rank(after), after)], reverse=True)
        del rank
    return placed


def pack(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    max_docs: int = 2048,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    score: str = "dot",
    vocabulary: str | None = None,
) -> DataFrame:
    """Pack all documents into sequences under three capacities.

    A piece's needs follow from its length alone, and there are at most ``capacity`` lengths.
    So the driver packs a histogram of at most that many counts, whatever the corpus' size, and
    gets placements for the items of each length by number. Pieces are numbered within length
    across partitions: a running sum over partitions of their counts gives each its first
    number. No text is shuffled and no bin depends on how the input was divided.

    Args:
        max_docs, max_cost: capacities for documents and for the sum of squared lengths; the
            defaults, capacity and capacity squared, don't bind beyond the token capacity.
        weights: of tokens, documents and cost in the scores.

    Returns:
        doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece. Null and
        empty texts have the end id alone. Rows of one id, equal ones too, are packed one by
        one. Texts of any length are tokenized whole. Other columns are ignored, whatever their
        names. An empty table gives an empty one.
    """
    max_cost = capacity * capacity if max_cost is None else max_cost
    with batches_of(docs.sparkSession, BATCH, BATCH_BYTES):
        pieces = store(cut_pieces(docs, capacity=capacity, vocabulary=vocabulary), "pieces")
    per_part = store(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = vector_best_fit(counts, capacity=capacity, max_docs=max_docs, max_cost=max_cost, weights=weights, score=score)
    table: dict[int, tuple[list, list, list]] = {}
    for length, first, _, start, offset in placed:
        a, b, c = table.setdefault(length, ([], [], []))
        a.append(first), b.append(start), c.append(offset)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for *piece, base, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, start, offset = table[piece[3]]
                j = bisect_right(first, base + nth) - 1
                rows.append((*piece, start[j] + base + nth - first[j], offset[j]))
            yield rows

    rows = pieces.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "base", "nth")
    fields = T._parse_datatype_string("sequence_id long, offset long")
    return map_rows(rows, place, [*rows.schema.fields[:5], *fields])
