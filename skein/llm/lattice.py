"""Language-model scores that sum over all segmentations of a text into subwords."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, store

#: The vocabulary's mark of a word's start.
START = "▁"

#: Words whose counts every task holds, at most; the others' are joined by shuffle.
HEAD = 200_000

#: Cells of a histogram of counts, to each doubling.
CELLS = 16

#: Distinct words that a task counts before it hands them on, and words of one lattice batch.
FLUSH, BATCH = 500_000, 20_000

#: What every piece is taken to have been seen besides, and rounds of estimation.
PRIOR, ROUNDS = 0.01, 3

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of an existing subword vocabulary and where they occur in words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = model.vocab_size(), model.eos_id()
        self.bytes = np.full(256, -1)
        pieces: dict[str, int] = {}
        self.rank = np.full(self.size, np.inf)  # by the vocabulary's scores, best first
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)) and START not in piece[1:]:
                pieces[piece] = i
                self.rank[i] = -model.get_score(i)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(pieces.values()))[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes >> np.uint64(42)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_MULTIPLIER) & 0xFFFFFFFFFFFFFFFF
        return h

    def first_weights(self) -> np.ndarray:
        """Weights from the vocabulary's own scores: Zipf's law in their order."""
        usual = 1 / (10 + self.rank)
        usual[self.bytes[self.bytes >= 0]] = 1e-6
        usual[self.end] = 1e-3
        return np.log(usual / usual.sum(), where=usual > 0, out=np.full(self.size, -np.inf))

    def edges(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 the piece at each place of the words' code points, or -1."""
        n = points.shape[1]
        found, h = [], np.zeros_like(points, np.uint64)
        for k in range(1, min(n, self.longest) + 1):
            h = (h[:, : n - k + 1] + points[:, k - 1 :].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
            ids = np.full(h.shape, -1)
            hit = np.nonzero(self.maybe[h >> np.uint64(42)])
            if len(hit[0]):
                at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                ids[hit] = np.where(self.hashes[at] == h[hit], self.ids[at], -1)
            found.append(ids)
        return found


@lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _sum_logs(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(0))


class Lattice:
    """All segmentations of words of one length, their logs of probability natural."""

    def place(self, vocabulary: Vocabulary, words: Sequence[str]) -> None:
        """Find the pieces at every place."""
        self.v, n = vocabulary, len(words[0])
        self.points = np.empty((len(words), n + 1), np.uint32)
        self.points[:, 0] = ord(START)
        self.points[:, 1:] = np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n) if n else 0
        self.ids = vocabulary.edges(self.points)
        self.bytewise = self.ids[0] < 0  # characters that aren't pieces go by their bytes

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray, words: Sequence[str]):
        self.place(vocabulary, words)
        n, table = len(words[0]), np.append(logs, -np.inf)
        self.logs = [table[ids] for ids in self.ids]
        for c in np.unique(self.points[self.bytewise]):
            own = chr(c).encode("utf-8", "surrogatepass")
            self.logs[0][self.bytewise & (self.points == c)] = sum(logs[self.v.bytes[b]] for b in own)
        self.forward = [np.zeros(len(words))]
        some = [(ids >= 0).any(0) for ids in self.ids]
        for j in range(1, n + 2):
            steps = [k for k in range(1, min(j, len(self.logs)) + 1) if k == 1 or some[k - 1][j - k]]
            self.forward.append(_sum_logs([self.forward[j - k] + self.logs[k - 1][:, j - k] for k in steps]))

    def totals(self) -> np.ndarray:
        """The log of each word's probability, summed over its segmentations."""
        return self.forward[-1]

    def expected(self, weights: np.ndarray, into: np.ndarray) -> None:
        """Add how often each piece is expected in the words, times their weights."""
        last = len(self.forward) - 1
        back = [np.zeros(len(weights))]
        for i in range(last - 1, -1, -1):
            terms = [back[last - i - k] + self.logs[k - 1][:, i] for k in range(1, min(last - i, len(self.logs)) + 1)]
            back.append(_sum_logs(terms))
        back.reverse()
        for k, (ids, logs) in enumerate(zip(self.ids, self.logs, strict=True), 1):
            for i in range(ids.shape[1]):
                share = weights * np.exp(self.forward[i] + logs[:, i] + back[i + k] - self.totals())
                self._add(ids[:, i], share, into)
                if k == 1:
                    self._add_bytes(i, share, into)

    @staticmethod
    def _add(ids: np.ndarray, share: np.ndarray, into: np.ndarray) -> None:
        into += np.bincount(ids + 1, share, len(into) + 1)[1:]

    def _add_bytes(self, place: int, share: np.ndarray, into: np.ndarray) -> None:
        for row in np.flatnonzero(self.bytewise[:, place]):
            for b in chr(self.points[row, place]).encode("utf-8", "surrogatepass"):
                into[self.v.bytes[b]] += share[row]


def expected_uses(vocabulary: Vocabulary, logs: np.ndarray, words: Sequence[str], weights: np.ndarray, into: np.ndarray) -> None:
    """As ``Lattice.expected`` for words of one length, by products of probabilities.

    That is several times faster than sums of logs; words whose probability comes near the
    least number are left to the lattice in logs.
    """
    lattice = Lattice.__new__(Lattice)
    lattice.place(vocabulary, words)
    table = np.append(np.exp(logs), 0.0)  # what has no piece, -1, has no share
    shares = [table[ids] for ids in lattice.ids]
    for c in np.unique(lattice.points[lattice.bytewise]):
        own = sum(logs[vocabulary.bytes[b]] for b in chr(c).encode("utf-8", "surrogatepass"))
        shares[0][lattice.bytewise & (lattice.points == c)] = math.exp(max(own, -700.0))
    last = lattice.points.shape[1]
    forward, back = np.zeros((last + 1, len(words))), np.zeros((last + 1, len(words)))
    forward[0] = back[last] = 1.0
    for j in range(1, last + 1):
        for k in range(1, min(j, len(shares)) + 1):
            forward[j] += forward[j - k] * shares[k - 1][:, j - k]
    for i in range(last - 1, -1, -1):
        for k in range(1, min(last - i, len(shares)) + 1):
            back[i] += back[i + k] * shares[k - 1][:, i]
    tiny = forward[last] < 1e-250
    per = np.where(tiny, 0.0, weights / np.where(tiny, 1.0, forward[last]))
    found = np.zeros(len(into))
    for k, (ids, own) in enumerate(zip(lattice.ids, shares, strict=True), 1):
        used = np.flatnonzero((ids >= 0).any(0) | (k == 1))
        for i in used:
            share = per * forward[i] * own[:, i] * back[i + k]
            lattice._add(ids[:, i], share, found)
            if k == 1:
                lattice._add_bytes(i, share, found)
    into += found
    if tiny.any():
        rest = np.flatnonzero(tiny)
        Lattice(vocabulary, logs, [words[r] for r in rest]).expected(weights[rest], into)


def _by_length(words: Iterable[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Batches of words of one length, with their places."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for i, word in enumerate(words):
        text = word.decode("utf-8", "surrogatepass")
        at, own = groups.setdefault(len(text), ([], []))
        at.append(i), own.append(text)
    for n, (at, own) in groups.items():
        step = max(1, min(BATCH, 400_000 // (n + 1)))
        for k in range(0, len(at), step):
            yield np.array(at[k : k + step]), own[k : k + step]


def word_logs(vocabulary: Vocabulary, logs: np.ndarray, words: Sequence[bytes]) -> np.ndarray:
    """The natural log of each word's marginal probability."""
    out = np.empty(len(words))
    for at, own in _by_length(words):
        out[at] = Lattice(vocabulary, logs, own).totals()
    return out


def split_words(text: str | None) -> list[bytes]:
    """Words between space and U+0009 to U+000D, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in all texts. Tasks add up before the shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split_words(text))
                if len(counts) >= FLUSH:
                    yield list(counts.items())
                    counts.clear()
        rows = list(counts.items())
        for k in range(0, len(rows), 50_000):
            yield rows[k : k + 50_000]

    rows = map_rows(docs.select("text"), made, T._parse_datatype_string("word binary, c long"))
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counted: DataFrame) -> dict[bytes, int]:
    """The most frequent words with their counts, at most HEAD of them.

    A histogram of the counts says from which count on there are so many; no task sorts words.
    """
    cell = F.floor(F.log2("c") * CELLS).cast("int")
    known, lowest = 0, None
    for at, n in sorted(counted.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        if known + n > HEAD:
            break
        known, lowest = known + n, at
    if lowest is None:
        return {}
    return {bytes(w): c for w, c in counted.filter(cell >= lowest).toLocalIterator()}


def fit_weights(counted: DataFrame, ends: int, path: str, *, rounds: int = ROUNDS) -> np.ndarray:
    """Estimate the pieces' log probabilities on counted words by expectation maximisation.

    The pieces and first weights are the existing vocabulary's. Each round sums the expected
    uses of at most that many pieces over all distinct words.
    """
    logs = _vocabulary(path).first_weights()
    for _ in range(rounds):
        now = logs

        def made(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[list[tuple]]:
            vocabulary = _vocabulary(path)
            uses = np.zeros(vocabulary.size)
            for batch in batches:
                words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
                for at, own in _by_length(words):
                    expected_uses(vocabulary, now, own, c[at], uses)
            yield [(int(i), float(uses[i])) for i in np.flatnonzero(uses)]

        rows = map_rows(counted.select("word", "c"), made, T._parse_datatype_string("piece int, uses double"))
        uses = np.full(len(logs), PRIOR)
        uses[~np.isfinite(logs)] = 0
        for piece, seen in rows.groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] += seen
        uses[_vocabulary(path).end] += ends
        logs = np.log(uses / uses.sum(), where=uses > 0, out=np.full(len(uses), -np.inf))
    return logs


def score_texts(docs: DataFrame, *, vocabulary: str | None = None, folds: int = 7, fold: int = 2) -> DataFrame:
    """Score every whole text by the sum over its segmentations into pieces.

    score is the log10 of a text's marginal probability: its words, each from its start mark,
    and one end are drawn piece by piece, independently, and summed over all segmentations by
    the forward recursion. The pieces are those of an existing vocabulary, and so are the first
    weights; ``fit_weights`` estimates them on the documents that aren't held out. The
    vocabulary itself stays as it is. word_arc_score is that of a lattice in which every word
    has one arc more, the word as a whole: with N training tokens of V kinds a word seen c times
    has (c + V * p) / (N + V), where p is what its pieces give.

    Words are counted over all training documents. Counts of the HEAD most frequent words are
    at hand in every task; a document's other words meet their counts in a join.

    Returns:
        doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_arc_score: a
        row per input row, repeated ones too. Null and empty texts have the end alone. Characters outside the
        vocabulary go by bytes, so that every score is finite. Texts of any length are read whole; a word
        is taken as a whole by a task, with some hundred bytes for each of its characters. Other columns
        are ignored, whatever their names. An empty table gives an empty one.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    train = docs.filter("not held_out")
    counted = store(count_words(train), "words")
    ends = train.count()
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    seen, distinct = total[0] + ends, total[1] + (ends > 0)
    logs = fit_weights(counted, ends, path)
    head = frequent_words(counted)
    whole, over = math.log10(max(distinct, 1)), math.log10(max(seen + distinct, 1))
    shared = docs.sparkSession.sparkContext.broadcast((head, logs))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        (known, weights), vocab = shared.value, _vocabulary(path)
        end, nth, part = float(weights[vocab.end]) / math.log(10), 0, TaskContext.get().partitionId()
        for batch in batches:
            index: dict[bytes, int] = {}
            told, places = [], []
            for doc, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = split_words(text)
                places.append(np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own)))
                told.append((doc, held))
            words = list(index)
            logs10 = word_logs(vocab, weights, words) / math.log(10)
            c = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            gains = np.log10(np.maximum(c, 0) + 1.0)
            mixed = np.where(c < 0, 0.0, np.logaddexp(np.log(np.maximum(c, 1e-300)), (logs10 + whole) * math.log(10)) / math.log(10) - over)
            rows = []
            for (doc, held), at in zip(told, places, strict=True):
                key, nth = (part << 40) | nth, nth + 1
                told_c, pure = c[at], float(logs10[at].sum()) + end
                rows.append((key, doc, held, len(at) + 1, int((told_c > 0).sum()), float(gains[at].sum()), float(mixed[at].sum()), pure, None, None))
                rare, times = np.unique(at[told_c < 0], return_counts=True)
                rows += [(key, None, None, None, None, None, None, float(logs10[i]), words[i], int(n)) for i, n in zip(rare, times, strict=True)]
            yield rows

    fields = "held_out boolean, n_tokens long, known long, gain double, mixed double, pure double, word binary, times long"
    kinds = [T.StructField("row", T.LongType()), docs.schema["doc_id"], *T._parse_datatype_string(fields)]
    rows = store(map_rows(docs, made, kinds), "scores")
    rare = rows.filter("word is not null").select("row", "word", "times", "pure")
    rare = rare.join(counted, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # c + V * p, in logs to base 10 for words of tiny p
    arc = F.when(F.col("c") > 0, F.log10(F.col("c") + F.pow(F.lit(10.0), F.col("pure") + whole))).otherwise(F.col("pure") + whole)
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("more_gain"),
        F.sum((arc - over) * F.col("times")).alias("more_mixed"),
    )
    out = rows.filter("word is null").join(rare, "row", "left")
    end = math.log10(ends + 1)
    floor = math.log10(seen + distinct + 1)
    piece = float(logs[_vocabulary(path).end]) / math.log(10)
    last = math.log10(ends + 10 ** (piece + whole)) - over
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(seen).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more_gain", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        F.col("pure").alias("score"),
        (F.col("mixed") + F.coalesce("more_mixed", F.lit(0.0)) + F.lit(last)).alias("word_arc_score"),
    )
