"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Labelled documents that the model is fitted on, at most; lines of a training sequence.
SAMPLE, STRETCH = 6_000, 64

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SYMBOLS, _STOPS, _DIGITS, _HIGH = b"#*$%&<>", b".,;:?", bytes(range(48, 58)), bytes(range(128, 256))

#: Values of a line of its own; those from the third on also stand for its neighbours.
OWN, SHARED = 14, 11


def _line(line: bytes, seen_lines: set, seen_grams: set) -> tuple[list[float], int]:
    words = line.split()
    n, size = len(words), len(line)
    grams = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    before = len(seen_grams)
    seen_grams.update(grams)
    fresh = len(seen_grams) - before
    key = b" ".join(words)
    again = n > 0 and key in seen_lines
    seen_lines.add(key)
    count = lambda kind: size - len(line.translate(None, kind))
    letters = count(_LETTERS)
    per = max(n, 1)
    return [
        1.0,
        np.log1p(n) / 5,
        float(n == 0),
        min(1.0, count(_SYMBOLS) / per),
        min(1.0, line.count(b"|") / per),
        min(1.0, line.count(b"!") / per),
        count(_UPPER) / max(letters, 1),
        count(_DIGITS) / max(size, 1),
        min(2.0, size / per / 10),
        1 - fresh / len(grams) if grams else 0.0,
        float(again),
        1 - len(set(words)) / per,
        min(1.0, count(_STOPS) / per),
        count(_HIGH) / max(size, 1),
    ], n


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of a text with those of its neighbours, and the lines' lengths.

    A null or empty text is one empty line. Lines without words count as lines.
    """
    lines = (text or "").split("\n")
    seen_lines: set = set()
    seen_grams: set = set()
    made = [_line(x.encode("utf-8", "surrogatepass"), seen_lines, seen_grams) for x in lines]
    own = np.array([m[0] for m in made])
    total = sum(m[1] for m in made)
    near = own[:, -SHARED:]
    pad = np.zeros((1, SHARED))
    ends = np.zeros((len(lines), 4))
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2], ends[:, 3] = np.log1p(total) / 10, total < 20
    whole = np.hstack([own, np.vstack([pad, near[:-1]]), np.vstack([near[1:], pad]), ends])
    return whole, np.array([len(x) + 1.0 for x in lines])


FEATURES = OWN + 2 * SHARED + 4


@dataclass
class Chain:
    """Weights of the good state's features over the bad one's, and of the steps between states."""

    weights: np.ndarray
    steps: np.ndarray  # [from, to]; 0 bad, 1 good
    slope: float = 1.0  # of the calibration of documents' log odds
    shift: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Each line's probability of being good, by forward and backward recursion."""
        emit = np.zeros((len(features), 2))
        emit[:, 1] = features @ self.weights
        return _recursions(emit[None], self.steps, np.ones((1, len(features)), bool))[0][0, :, 1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _recursions(emit: np.ndarray, steps: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of states, expected steps and log normalisers of padded sequences."""
    n, length, _ = emit.shape
    forward = np.empty_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        new = _logsum(forward[:, t - 1, :, None] + steps, 1) + emit[:, t]
        forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
    total = _logsum(forward[:, -1], 1)
    back = np.zeros((n, 2))
    states, moves = np.empty_like(emit), np.zeros((2, 2))
    states[:, -1] = np.exp(forward[:, -1] - total[:, None])
    for t in range(length - 1, 0, -1):
        on = real[:, t]
        ahead = emit[:, t] + back
        pair = np.exp(forward[:, t - 1, :, None] + steps + ahead[:, None, :] - total[:, None, None])
        moves += pair[on].sum(0)
        back = np.where(on[:, None], _logsum(steps + ahead[:, None, :], 2), back)
        states[:, t - 1] = np.exp(forward[:, t - 1] + back - total[:, None])
    return states, moves, total


def fit(sequences: list[np.ndarray], labels: list[int], *, rounds: int = 250, ridge: float = 1e-3, rate: float = 0.1) -> Chain:
    """Fit a chain by gradient ascent (Adam) on the likelihood of the lines' labels.

    A document's label stands for all its lines. Without sequences the chain is undecided.
    """
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    parts = [(x[k : k + STRETCH], y) for x, y in zip(sequences, labels, strict=True) for k in range(0, len(x), STRETCH)]
    if not parts:
        return chain
    parts.sort(key=lambda p: len(p[0]))
    batches = []
    for k in range(0, len(parts), 512):
        own = parts[k : k + 512]
        longest = max(len(x) for x, _ in own)
        x = np.zeros((len(own), longest, FEATURES))
        real = np.zeros((len(own), longest), bool)
        for i, (f, _) in enumerate(own):
            x[i, : len(f)], real[i, : len(f)] = f, True
        batches.append((x, real, np.array([y for _, y in own], float)))
    count = sum(real.sum() for _, real, _ in batches)
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for turn in range(1, rounds + 1):
        grad = -ridge * theta
        steps = theta[FEATURES:].reshape(2, 2)
        for x, real, y in batches:
            emit = np.zeros((*real.shape, 2))
            emit[..., 1] = x @ theta[:FEATURES]
            states, moves, _ = _recursions(emit, steps, real)
            wrong = np.where(real, y[:, None] - states[..., 1], 0.0)
            grad[:FEATURES] += np.tensordot(wrong, x, 2) / count
            told = np.zeros((2, 2))
            per = real.sum(1) - 1
            told[0, 0], told[1, 1] = per[y == 0].sum(), per[y == 1].sum()
            grad[FEATURES:] += (told - moves).ravel() / count
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-9)
    return Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def log_odds(chain: Chain, features: np.ndarray, lengths: np.ndarray) -> float:
    """Of the lines' probabilities of being good, weighted by length."""
    share = np.clip(chain.marginals(features) @ lengths / lengths.sum(), 1e-6, 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def calibrate(odds: np.ndarray, labels: np.ndarray, *, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the log odds that fit the labels best, by Newton's method."""
    x = np.column_stack([odds, np.ones(len(odds))])
    theta = np.array([1.0, 0.0])
    for _ in range(rounds if len(set(labels.tolist())) == 2 else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (labels - p) - 0.01 * (theta - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta + step / max(1.0, np.abs(step).max())
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def document_score(chain: Chain, text: str | None) -> float:
    """A document's calibrated probability of being good."""
    odds = chain.slope * log_odds(chain, *line_features(text)) + chain.shift
    return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is held out: crc32 of its id as text; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_documents(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Chain:
    """Fit on labelled documents that aren't held out, at most ``sample`` of them, by hash of id.

    The chain is fitted to the lines, then the documents' log odds are calibrated on the same
    documents, so that a score is the probability of label 1.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, 0.95 * sample / max(1, known.count()))
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = known.filter(part).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, quality, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                features, lengths = line_features(text)
                rows.append((doc, quality, features.astype("<f4").tobytes(), lengths.astype("<f4").tobytes()))
            yield rows

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    told = map_rows(joined, made, T._parse_datatype_string("doc_id long, quality int, features binary, lengths binary")).collect()
    told.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    sequences = [np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES).astype(float) for r in told]
    labels = np.array([int(r["quality"]) for r in told])
    chain = fit(sequences, labels.tolist())
    odds = [log_odds(chain, x, np.frombuffer(r["lengths"], "<f4").astype(float)) for x, r in zip(sequences, told, strict=True)]
    chain.slope, chain.shift = calibrate(np.array(odds), labels)
    return chain


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """Score every whole text for quality.

    Returns:
        doc_id, held_out, score (0 to 1), predicted (1 from ``cut`` on): a row per input row.
        Null and empty texts are one empty line. Without labels every score is 0.5. Repeated rows
        are scored alike, each by its own text; texts of any length are read whole. Other columns are
        ignored, whatever their names. An empty table gives an empty one.
    """
    chain = fit_documents(docs, labels, sample=sample)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                score = document_score(chain, text)
                rows.append((doc, held, score, int(score >= cut)))
            yield rows

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, made, [docs.schema["doc_id"], *T._parse_datatype_string("held_out boolean, score double, predicted int")])
