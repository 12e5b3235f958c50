"""A quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of its characters and words and the same of the lines before and
after it. Forward-backward gives each line's probability of being good; their mean weighted by
length is the document's quality. The model is fitted on a bounded sample of labelled rows:
a document's label is taken for each of its lines, and the chain smooths over lines that look
unlike their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, gathered, labelled_sample, slices, tidy

#: Training documents of each class: the bound of the sample. Their texts take part whole.
PER_CLASS = 1500
#: Lines of a chain in the fit; longer documents are several chains there.
FIT_RUN = 64
ROUNDS = 250
BASE = 14

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _OTHER = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[32, 9, 11, 12, 13]] = _SPACE
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = _STOP
_KIND[128:] = _OTHER


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line by itself, each line's length)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    starts = np.cumsum(n + 1) - n - 1
    full = n > 0
    counts = np.zeros((len(lines), 7))
    if full.any():
        for k in range(7):
            # Between two starts stands the newline, counted as a mark: taken off below.
            counts[full, k] = np.add.reduceat((kinds == k).astype(np.int32), starts[full])
        ends = np.zeros(len(lines), bool)
        at = np.flatnonzero(full)
        ends[at] = True
        after = np.diff(np.concatenate((starts[full], [len(data)]))) - n[full]
        counts[full, _MARK] -= after
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.float64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, len(words))
    pairs = np.fromiter((len(set(zip(w, w[1:], strict=False))) for w in words), np.float64, len(words))
    long_ = np.maximum(n, 1)
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _OTHER], 1)
    own = np.empty((len(lines), BASE))
    own[:, 0] = counts[:, _UPPER] / letters
    own[:, 1] = counts[:, _LOWER] / letters
    own[:, 2] = counts[:, _DIGIT] / long_
    own[:, 3] = counts[:, _SPACE] / long_
    own[:, 4] = counts[:, _STOP] / long_
    own[:, 5] = np.sqrt(np.maximum(counts[:, _MARK], 0) / long_)
    own[:, 6] = counts[:, _OTHER] / long_
    own[:, 7] = 1 - distinct / np.maximum(n_words, 1)
    own[:, 8] = (n_words - 1 - pairs) / np.maximum(n_words - 1, 1) * (n_words > 1)
    own[:, 9] = np.minimum(letters / np.maximum(n_words, 1), 30) / 10
    own[:, 10] = np.log1p(n) / 5
    own[:, 11] = np.log1p(n_words) / 5
    own[:, 12] = n == 0
    own[:, 13] = np.minimum(np.maximum(counts[:, _MARK], 0) / np.maximum(n_words, 1), 4) / 2
    return own, n


def beside(own: np.ndarray) -> np.ndarray:
    """Features of a document's lines, those of the lines before and after beside each; flags say where there is none."""
    none = np.zeros((1, BASE))
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack((own, np.vstack((none, own[:-1])), np.vstack((own[1:], none)), edge))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, each line's length): neighbours' features stand beside its own."""
    own, n = own_features(text)
    return beside(own), n


@dataclass
class Chain:
    """A two-label chain: a weight for each feature, a start weight and a gain for equal neighbours."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    stay: np.ndarray  # log potentials of (bad, bad), (bad, good), (good, bad), (good, good)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias


def marginals(score: np.ndarray, size: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected counts of the four transitions, by forward-backward.

    `score` holds the good label's log potential (the bad one's is 0) of all lines of all
    sequences, one after another; `size` the sequences' lengths. Sequences go along together.
    """
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    ahead, back = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    t = stay.reshape(2, 2)
    for k, n in enumerate(alive):
        at = start[:n] + k
        if k:
            ahead[at] = np.logaddexp(ahead[at - 1][:, 0:1] + t[0], ahead[at - 1][:, 1:2] + t[1])
        ahead[at, 1] += score[at]
        ahead[at] -= ahead[at].max(axis=1, keepdims=True)
    for k in range(len(alive) - 2, -1, -1):
        at = start[: alive[k + 1]] + k
        nxt = back[at + 1].copy()
        nxt[:, 1] += score[at + 1]
        back[at] = np.logaddexp(nxt[:, 0:1] + t[:, 0], nxt[:, 1:2] + t[:, 1])
        back[at] -= back[at].max(axis=1, keepdims=True)
    both = ahead + back
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    first = np.zeros(len(score), bool)
    first[start] = True
    later = np.flatnonzero(~first)
    nxt = back[later].copy()
    nxt[:, 1] += score[later]
    joint = ahead[later - 1][:, :, None] + t[None] + nxt[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return p, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0).ravel()


def fit(feats: list[np.ndarray], labels: list[int]) -> Chain:
    """From the features of the lines of each document of the sample, and the documents' labels.

    Penalised likelihood by Adam over the sample; no rows or one class give an even chain."""
    width = 3 * BASE + 2
    if len(set(labels)) < 2:
        lean = 4.0 * (2 * labels[0] - 1) if labels else 0.0
        return Chain(np.zeros(width), np.ones(width), np.zeros(width), lean, np.zeros(4))
    lines = np.array([len(f) for f in feats])
    x = np.vstack(feats).astype(float)
    y = np.repeat(np.array(labels, float), lines)
    # Chains of FIT_RUN lines at most: every line takes part, and a round takes as many steps at most.
    size = np.array([min(FIT_RUN, n - a) for n in lines.tolist() for a in range(0, n, FIT_RUN)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    start = np.cumsum(size) - size
    first = np.zeros(len(x), bool)
    first[start] = True
    later = np.flatnonzero(~first)
    seen = np.bincount((2 * y[later - 1] + y[later]).astype(int), minlength=4).astype(float)
    per_doc = np.repeat(1 / np.sqrt(lines), lines)  # long documents don't drown short ones
    theta = np.zeros(width + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        p, found = marginals(x @ theta[:width] + theta[width], size, theta[width + 1 :])
        gap = (y - p) * per_doc
        grad = np.concatenate((gap @ x, [gap.sum()], (seen - found) * per_doc.mean())) / len(lines)
        grad -= np.concatenate((2e-3 * theta[:width], [0.0], 3e-2 * theta[width + 1 :]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(mean, scale, theta[:width].copy(), float(theta[width]), theta[width + 1 :].copy())


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """Fit on at most `per_class` labelled training rows of each class (see `labelled_sample`).

    Of each row its lines' own features reach the driver, never its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = [own_features(t)[0].ravel().astype(np.float32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(feats, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "label", "text")
    feats, known = gathered(sample.mapInArrow(run, "doc_id string, label int, x array<float>"), "x")
    return fit([beside(x.reshape(-1, BASE)) for x in feats], known)


def qualities(texts: list[str | None], chain: Chain) -> np.ndarray:
    """Each text's quality: P(good) of its lines, weighted by their lengths plus one."""
    if not texts:
        return np.empty(0)
    emissions, sizes, lengths = [], [], []
    for text in texts:
        x, n = line_features(text)
        emissions.append(chain.emissions(x))
        sizes.append(len(n))
        lengths.append(n + 1)
    p, _ = marginals(np.concatenate(emissions), np.array(sizes), chain.stay)
    weight = np.concatenate(lengths)
    start = np.cumsum(sizes) - sizes
    return np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start)


def with_quality(docs: DataFrame, chain: Chain, name: str = "score") -> DataFrame:
    """`docs` with a double column `name`, 0 to 1, of every whole text.

    Null texts score as empty ones, which are one empty line; equal texts score equally up to
    rounding in the last place. A column already called `name` is replaced.
    """
    rows = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                scores = np.clip(qualities(part.column("text").to_pylist(), chain), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (name, "double")]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs` whose quality reaches the threshold, with the columns of `docs`."""
    name = fresh(docs, "quality_score")
    scored = with_quality(docs, train(docs, labels, per_class), name)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
