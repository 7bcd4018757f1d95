"""Document quality from a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features describe its own characters and words and those of the lines before
and after it; two neighbouring lines share a weight for each pair of labels. The forward-backward pass gives
the probability that a line is good given the whole text, and the quality of a document is the mean of these,
weighted by line length. Labels are known for documents only, so in training all lines of a document carry its
label.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crowdtape.llm.common import arrow_map, others, packed, pieces_of, unpacked

# The model is fitted on at most this many labelled documents, those with the smallest key hashes.
SAMPLE = 8000
STEPS = 200
_CHUNK = 1 << 22

# Classes of UTF-8 bytes: each byte that starts a character belongs to one.
_CLASSES = ["upper", "lower", "digit", "blank", "symbol", "shout", "stop", "mark", "other", "wide", "rest"]
_SYMBOLS = b"#*$%&|<>"


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _CLASSES.index("other"), np.int64)
    kinds[0x80:0xC0] = _CLASSES.index("rest")
    kinds[0xC0:] = _CLASSES.index("wide")
    for name, members in (
        ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("blank", b" \t\r\f\v"),
        ("symbol", _SYMBOLS), ("shout", b"!"), ("stop", b".?"), ("mark", b",;:'\"()-"),
    ):
        kinds[list(members)] = _CLASSES.index(name)
    return kinds


_KINDS = _byte_classes()
OWN = 25
_WIDTH = 3 * OWN + 3


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, their lengths in characters, and each text's number of lines."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(flat == 10)
    sizes = np.diff(ends, prepend=-1) - 1
    lines = np.array([text.count(b"\n") + 1 for text in raw], np.int64)
    kinds = np.zeros((len(ends), len(_CLASSES)), np.int64)
    cut = 0
    while cut < len(ends):  # by lines, so that the work arrays stay small
        after = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else -1) + _CHUNK)))
        a, b = (int(ends[cut - 1]) + 1 if cut else 0), int(ends[after - 1]) + 1
        line = np.repeat(np.arange(after - cut), sizes[cut:after] + 1)
        counted = np.bincount(line * len(_CLASSES) + _KINDS[flat[a:b]], minlength=(after - cut) * len(_CLASSES))
        kinds[cut:after] = counted.reshape(-1, len(_CLASSES))
        cut = after
    kinds[:, _CLASSES.index("other")] -= 1  # the line end itself
    words, distinct, longest, again = (np.zeros(len(ends)) for _ in range(4))
    at = 0
    for text in raw:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            mine = line.split()
            if mine:
                words[at], distinct[at], longest[at] = len(mine), len(set(mine)), max(map(len, mine))
                again[at] = line in seen
                seen.add(line)
            at += 1
    share = {name: kinds[:, i] for i, name in enumerate(_CLASSES)}
    chars = kinds.sum(axis=1) - share["rest"]
    size, count = np.maximum(chars, 1), np.maximum(words, 1)
    last = flat[np.maximum(ends - 1, 0)]
    part = {name: share[name] / size for name in _CLASSES}
    unlike = distinct / count
    own = np.column_stack([
        np.log1p(chars) / 5, np.log1p(words) / 4, words / size, part["upper"], part["lower"], part["digit"],
        part["symbol"], part["shout"], part["stop"], part["mark"], part["other"], part["wide"],
        np.minimum(longest, 100) / 20, unlike, (1 - unlike) * np.log1p(words),
        np.isin(last, list(b".?!")) & (chars > 0), again, chars == 0,
        part["symbol"] > 0.03, part["shout"] > 0.03, part["upper"] > 0.3, part["digit"] > 0.15,
        unlike < 0.5, unlike < 0.2, part["stop"] > 0.1,
    ]).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lines)[:-1])).astype(np.int64)
    first, final = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    first[starts], final[starts + lines - 1] = True, True
    before = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
    after = np.where(final[:, None], 0.0, np.roll(own, -1, axis=0))
    rows = np.column_stack([own, before, after, first, final, np.ones(len(ends))])
    return rows, chars, lines


@dataclass
class Model:
    """Weights of the good label, of each pair of neighbouring labels, and the share of good documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    prior: float

    def marginals(self, rows: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        return chain_marginals(((rows - self.mean) / self.scale) @ self.weights, self.pairs, lines)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Mean probability of the lines of each text, by length; the prior for a text without characters."""
        rows, chars, lines = line_features(texts)
        good = self.marginals(rows, lines)
        owner = np.repeat(np.arange(len(lines)), lines)
        weight = np.bincount(owner, chars, len(lines))
        total = np.bincount(owner, chars * good, len(lines))
        return np.where(weight > 0, np.clip(total / np.maximum(weight, 1), 0, 1), self.prior)


def chain_marginals(scores: np.ndarray, pairs: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each pair of neighbouring labels in each chain.

    ``scores`` favour the good label, line after line of chain after chain. All chains advance together,
    the longest first, so each step works on those that are still running.
    """
    starts = np.concatenate(([0], np.cumsum(lines)[:-1])).astype(np.int64)
    order = np.argsort(-lines, kind="stable")
    starts, lengths = starts[order], lines[order]
    steps = int(lengths[0]) if len(lengths) else 0
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
    factor = np.exp(pairs)
    emit = np.column_stack([np.exp(-np.logaddexp(0, scores)), np.exp(-np.logaddexp(0, -scores))])
    forward, backward = np.zeros((len(scores), 2)), np.ones((len(scores), 2))
    for t in range(steps):
        at = starts[:running[t]] + t
        reach = emit[at] if t == 0 else (forward[at - 1] @ factor) * emit[at]
        forward[at] = reach / reach.sum(axis=1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        at = starts[:running[t]] + t
        reach = (backward[at] * emit[at]) @ factor.T
        backward[at - 1] = reach / reach.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    expected = np.zeros((len(lines), 2, 2))
    follows = np.ones(len(scores), bool)
    follows[starts] = False
    at = np.flatnonzero(follows)
    if len(at):
        joint = forward[at - 1][:, :, None] * factor * (backward[at] * emit[at])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        chain = np.empty(len(scores), np.int64)
        chain[:] = np.repeat(np.arange(len(lines)), lines)
        for i in (0, 1):
            for j in (0, 1):
                expected[:, i, j] = np.bincount(chain[at], joint[:, i, j], len(lines))
    return good, expected


def fit(rows: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Model:
    """Greatest conditional likelihood of the documents' labels on their lines, by Adam on all rows at once."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    inputs = (rows - mean) / scale
    owner = np.repeat(np.arange(len(lines)), lines)
    target = labels[owner].astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (lines[labels == label] - 1).sum()
    theta, count = np.zeros(inputs.shape[1] + 4), len(lines)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected = chain_marginals(inputs @ weights, pairs, lines)
        slope = np.concatenate((inputs.T @ (good - target), (expected.sum(axis=0) - seen).ravel())) / count
        slope += ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(labels.mean()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches):
        rows, _, lines = line_features(batch.column(0).to_pylist())
        cells = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(lines) * rows.shape[1])).astype(np.int32)),
            pa.array(rows.astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(1), cells], names=["label", "cells"])


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled documents among the rows of ``labels`` where ``learn_from``.

    The features of those documents, some hundred bytes a line, are fitted on the driver. Labels that are
    NULL teach nothing; without any label there is no model.
    """
    known = labels.where(learn_from & F.col(f"`{label_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id").select("_text", "label")
    found = arrow_map(joined, _features, "label int, cells array<float>").toArrow()
    if not len(found):
        return None
    cells = found.column("cells").combine_chunks()
    rows = cells.flatten().to_numpy().astype(np.float64).reshape(-1, _WIDTH)
    lines = np.diff(cells.offsets.to_numpy()) // _WIDTH
    return fit(rows, lines, (found.column("label").to_numpy() > 0).astype(np.int64))


def with_quality(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from 0 (bad) to 1 (good); a column of that name is replaced.

    NULL and empty texts have the share of good documents in training as score, and without a model every
    text has 0.5. All other columns pass unread, whatever they hold; repeated rows each get their score.
    """
    passed = others(docs, score_col)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in passed], F.lit(0.5).alias(score_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            scores = shared.value.scores(piece.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(scores)], names=["_row", "_score"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), packed(passed))
    scored = arrow_map(rows, work, T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())]))
    return scored.select(*unpacked(passed), F.col("_score").alias(score_col))
