"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's score comes from its own features and those of the lines before and after it, and
labels of neighbouring lines are tied by transition weights. Forward-backward marginals, weighted by line length, give
the share of good text; a logistic curve fitted on the training documents turns that into the document's score.
The model is fitted on the driver from a bounded sample of labelled documents; scoring runs in tasks, document by
document, over whole texts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick

_EDGES = np.array([0.0, 0.02, 0.08, 0.2, 0.45])
_SIZES = np.array([0, 2, 5, 15, 60])
_CLASSES = ("upper", "digit", "mark", "odd", "bar", "space")
_MEASURES = 7  # shares of the classes without space, repeated words, neighbouring equal words
_WIDTH = _MEASURES * (len(_EDGES) + 1) + len(_SIZES) + 1
FEATURES = 3 * _WIDTH + 1


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    table[ord("A") : ord("Z") + 1] = 0
    table[ord("0") : ord("9") + 1] = 1
    table[[ord(c) for c in ".,;:'\"()-?"]] = 2
    table[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 3
    table[ord("|")] = 4
    table[[9, 11, 12, 13, 32]] = 5
    return table


_TABLE = _class_table()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of all texts, in order: indices of the active features (lines x columns), line lengths in bytes,
    and how many lines each text has. A text without characters is one empty line."""
    lines = [line for text in texts for line in text.split(b"\n")]
    counts = np.array([text.count(b"\n") + 1 for text in texts])
    lengths = np.array([len(line) for line in lines])
    shares = np.zeros((len(lines), _MEASURES))
    marks = _TABLE[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    spaces = np.add.reduceat(marks == 5, starts, dtype=np.int32)
    solid = np.maximum(lengths - spaces, 1)
    for k in range(5):
        shares[:, k] = np.add.reduceat(marks == k, starts, dtype=np.int32) / solid
    sizes = np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        words = line.split()
        n = sizes[i] = len(words)
        if n > 1:
            shares[i, 5] = 1 - len(set(words)) / n if n > 8 else 0
            shares[i, 6] = sum(map(operator.eq, words, words[1:])) / (n - 1)
    own = np.empty((len(lines), _MEASURES + 1), np.int64)
    for k in range(_MEASURES):
        own[:, k] = k * (len(_EDGES) + 1) + np.searchsorted(_EDGES, shares[:, k], side="left")
    own[:, _MEASURES] = _MEASURES * (len(_EDGES) + 1) + np.searchsorted(_SIZES, sizes, side="left")
    # the feature FEATURES stands for "no such neighbour" and has weight zero
    before, after = np.full_like(own, FEATURES), np.full_like(own, FEATURES)
    before[1:], after[:-1] = own[:-1] + _WIDTH, own[1:] + 2 * _WIDTH
    ends = np.cumsum(counts)
    before[ends - counts], after[ends - 1] = FEATURES, FEATURES
    bias = np.full((len(lines), 1), FEATURES - 1)
    return np.hstack([own, before, after, bias]), lengths, counts


def marginals(scores: np.ndarray, counts: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transition counts (2 x 2) and the log of the partition functions, by
    forward-backward over all texts at once. A line scores `scores` as good and 0 as bad."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    top = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(top), side="left")
    forward = np.zeros((len(scores), 2))
    backward = np.zeros((len(scores), 2))
    forward[begin, 1] = scores[begin]
    for t in range(1, top):
        at = begin[: active[t]] + t
        before = forward[at - 1][:, :, None] + tie
        forward[at] = np.logaddexp(before[:, 0], before[:, 1])
        forward[at, 1] += scores[at]
    for t in range(top - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = backward[at + 1].copy()
        ahead[:, 1] += scores[at + 1]
        after = tie + ahead[:, None, :]
        backward[at] = np.logaddexp(after[:, :, 0], after[:, :, 1])
    last = begin + sizes - 1
    log_z = np.logaddexp(forward[last, 0], forward[last, 1])
    of_line = np.empty(len(scores))
    of_line[:] = np.repeat(log_z[np.argsort(order)], counts)
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - of_line, 0))
    inner = np.ones(len(scores), bool)
    inner[begin] = False
    here = np.flatnonzero(inner)
    ahead = backward[here].copy()
    ahead[:, 1] += scores[here]
    pairs = np.exp(forward[here - 1][:, :, None] + tie + ahead[:, None, :] - of_line[here][:, None, None])
    return good, pairs.sum(0), float(log_z.sum())


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray  # FEATURES + 1, the last always zero
    tie: np.ndarray  # transitions, bad and good
    slope: float
    offset: float

    def share_good(self, texts: list[bytes]) -> np.ndarray:
        columns, lengths, counts = line_features(texts)
        good, _, _ = marginals(self.weights[columns].sum(1), counts, self.tie)
        mass = lengths + 1.0
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * mass, starts) / np.add.reduceat(mass, starts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        share = np.clip(self.share_good(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.offset)))


def _fit_lines(columns: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam over all lines at once."""
    weights, tie = np.zeros(FEATURES + 1), np.zeros((2, 2))
    starts = np.cumsum(counts) - counts
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[here - 1], labels[here]), 1)
    flat = columns.ravel()
    moment, square = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(weights[columns].sum(1), counts, tie)
        slope = np.bincount(flat, np.repeat(labels - good, columns.shape[1]), FEATURES + 1)
        gradient = np.concatenate([slope / len(labels) - penalty * weights, ((seen - pairs) / len(labels)).ravel() - penalty * tie.ravel()])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights += move[:-4]
        tie += move[-4:].reshape(2, 2)
        weights[FEATURES] = 0
    return weights, tie


def fit(texts: list[bytes], labels: list[int], steps: int = 60, rounds: int = 2) -> LineModel:
    """Lines start with their document's label. In each further round a line of a bad document is bad where the model
    of the round before finds it so, or where it is the least good line of its document."""
    if len(set(labels)) < 2:
        # nothing to tell apart: every score is the share of good labels, one half without any
        share = np.clip(np.mean(labels) if labels else 0.5, 0.01, 0.99)
        return LineModel(np.zeros(FEATURES + 1), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    columns, _, counts = line_features(texts)
    of_doc = np.asarray(labels)
    starts = np.cumsum(counts) - counts
    line_labels = np.repeat(of_doc, counts)
    for _ in range(rounds):
        weights, tie = _fit_lines(columns, counts, line_labels, steps)
        good, _, _ = marginals(weights[columns].sum(1), counts, tie)
        worst = np.minimum.reduceat(good, starts)
        line_labels = np.where(np.repeat(of_doc, counts) == 1, 1, (good > 0.5) & (good > np.repeat(worst, counts))).astype(int)
    model = LineModel(weights, tie, 1.0, 0.0)
    share = np.clip(model.share_good(texts), 1e-6, 1 - 1e-6)
    x, slope, offset = np.log(share / (1 - share)), 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        slope += 0.05 * (np.mean((of_doc - p) * x) - 1e-3 * slope)
        offset += 0.2 * np.mean(of_doc - p)
    return LineModel(weights, tie, float(max(slope, 1e-3)), float(offset))


def fit_on_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 1500, max_chars: int = 20_000) -> LineModel:
    """Fits on at most `max_docs` labelled documents, those with the least hash of their id, none of the held-out fold
    (crc32 of the id as text, modulo 5, is 0); documents of over `max_chars` characters are left out of the sample."""
    named = pick(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label in (0, 1)")
    chosen = named.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = pick(docs, doc_id=id_col, text=text_col).filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(chosen), "doc_id").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), F.col("label").cast("int").alias("label"))
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["data"])))  # max_docs x max_chars bound it
    return fit([bytes(r["data"]) for r in rows], [r["label"] for r in rows])


def _scores(model: LineModel, texts: pa.Array, step_bytes: int) -> np.ndarray:
    scores, held, size = [np.zeros(0)], [], 0
    for text in texts:
        held.append((text.as_py() or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= step_bytes:
            scores.append(model.score(held))
            held, size = [], 0
    if held:
        scores.append(model.score(held))
    return np.concatenate(scores)


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text", threshold: float = 0.3, step_bytes: int = 1 << 20) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores `threshold` or more; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at), step_bytes) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, step_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are one empty line and are scored like any other; texts of any length are scored whole. A null
    id is not held out. Only the text decides the score; rows may repeat; an empty table gives an empty result; other
    columns of the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1), step_bytes), pa.float64())], ["doc_id", "score"])

    scored = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
