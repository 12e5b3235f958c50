"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and word beginnings, hashed. The machine scores it by a bias,
a weight for each term and the inner products of the terms' factors, so that two terms
together (an insult and the group it is aimed at) can weigh more than each alone. It is fitted
on a bounded sample of labelled rows; terms that tell the classes apart there take part, and
those that do so only beside another term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lexispark.llm.common import gathered, labelled_sample, slices, tidy

#: Bounds of the sample and the model.
PER_CLASS = 3000
HASH_BITS = 18
TERMS = 512
FACTORS = 8
ROUNDS = 400
#: Frequent terms whose pairs are looked at, terms that these may add, and the chi-square that a pair must reach.
PAIRED, PAIR_TERMS, PAIR_CHI = 1024, 64, 100.0
#: Words whose terms a task remembers, before it forgets them all.
REMEMBERED = 300_000

#: ASCII letters stay, other ASCII characters part words; bytes of other characters stay.
_PART = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_PART).split())


def terms_of(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its first 4 and 5 characters."""
    mask, out = (1 << HASH_BITS) - 1, [xxhash.xxh64_intdigest(b"w" + word)]
    letters = word.decode("utf-8", "surrogatepass")
    for n in (4, 5):
        if len(letters) >= n:
            out.append(xxhash.xxh64_intdigest(b"%d" % n + letters[:n].encode("utf-8", "surrogatepass")))
    return tuple(h & mask for h in out)


def all_terms(text: str | None) -> list[int]:
    return sorted({t for w in words_of(text) for t in terms_of(w)})


@dataclass
class Machine:
    """place: a hashed term's row among the terms that take part, or -1."""

    place: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(toxic) of texts given as the rows of their terms."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.concatenate(rows).astype(np.int64) if len(owner) else np.empty(0, np.int64)
        return _sigmoid(_raw(at, owner, len(rows), self.weight, self.factor, self.bias)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows of the same owner."""
    out = np.zeros((n, *values.shape[1:]))
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _raw(at, owner, n, weight, factor, bias):
    f = factor[at]
    total = _sums(f, owner, n)
    pairs = 0.5 * (total**2 - _sums(f**2, owner, n)).sum(axis=1)
    return bias + _sums(weight[at], owner, n) + pairs, total


def _chi(with1, with0, n1, n0) -> np.ndarray:
    """Chi-square of a term's presence against the class, from its counts in both classes and the classes' sizes."""
    off = with1 * (n0 - with0) - with0 * (n1 - with1)
    return (n1 + n0) * off**2 / np.maximum((with1 + with0) * (n1 + n0 - with1 - with0) * n1 * n0, 1)


def paired_terms(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Terms among `often` that tell the classes apart in the texts that have some other of them, the clearest first."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[often] = np.arange(len(often))
    at = place[flat]
    has = np.zeros((len(y), len(often)), np.float32)
    has[owner[at >= 0], at[at >= 0]] = 1
    both1, both0 = (has[y == k].T @ has[y == k] for k in (1, 0))
    both1, both0 = both1.astype(float), both0.astype(float)
    chi = _chi(both1, both0, np.diag(both1)[:, None], np.diag(both0)[:, None])  # of a column's term among texts with a row's
    best = np.maximum(chi.max(axis=0), 0)
    order = np.argsort(-best, kind="stable")
    return often[order[best[order] >= PAIR_CHI]]


def fit(terms: list[np.ndarray], labels: list[int]) -> Machine:
    """Choose terms by chi-square and fit by Adam with penalties; one class or no rows give a constant.

    Terms that are significant by themselves come first, then those that are so in pairs.
    """
    place = np.full(1 << HASH_BITS, -1, np.int32)
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        lean = 4.0 * (2 * labels[0] - 1) if labels else -4.0
        return Machine(place, np.zeros(1), np.zeros((1, FACTORS)), lean)
    n1, n0 = y.sum(), len(y) - y.sum()
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    flat, owner = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(len(terms)), size)
    with1 = np.bincount(flat, weights=y[owner], minlength=len(place))
    with0 = np.bincount(flat, minlength=len(place)) - with1
    chi = np.where(with1 + with0 >= 3, _chi(with1, with0, n1, n0), 0)
    top = np.argsort(-chi, kind="stable")[:TERMS]
    top = top[chi[top] > 10.8]  # one term in a thousand reaches this by chance
    often = np.argsort(-(with1 + with0), kind="stable")[:PAIRED]
    paired = paired_terms(flat, owner, y, often[(with1 + with0)[often] >= 3])
    top = np.concatenate((top, paired[chi[paired] <= 10.8][:PAIR_TERMS]))
    if not len(top):
        return Machine(place, np.zeros(1), np.zeros((1, FACTORS)), float(np.log(n1 / n0)))
    place[top] = np.arange(len(top))
    known = place[flat] >= 0
    at, owner = place[flat[known]].astype(np.int64), owner[known]
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(len(top)), rng.normal(0, 0.01, (len(top), FACTORS)), 0.0
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0)  # both classes weigh the same
    state = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (w, v, b)]
    for step in range(1, ROUNDS + 1):
        z, total = _raw(at, owner, len(y), w, v, b)
        gap = (_sigmoid(z) - y) * each
        g = gap[owner]
        gw = np.bincount(at, weights=g, minlength=len(top)) + 2e-5 * w
        gv = np.empty_like(v)
        for k in range(FACTORS):
            gv[:, k] = np.bincount(at, weights=g * (total[owner, k] - v[at, k]), minlength=len(top))
        gv += 2e-4 * v
        new = []
        for p, grad, (m, s) in zip((w, v, b), (gw, gv, gap.sum()), state, strict=True):
            m[...] = 0.9 * m + 0.1 * grad
            s[...] = 0.99 * s + 0.01 * grad**2
            new.append(p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9))
        w, v, b = new[0], new[1], float(new[2])
    return Machine(place, w, v, b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Fit on at most `per_class` labelled training rows of each class (see `labelled_sample`).

    Of each row its distinct hashed terms reach the driver, 2**HASH_BITS at most, not its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    sample = labelled_sample(docs, labels, "toxic", per_class).select("doc_id", "label", "text")
    return fit(*gathered(sample.mapInArrow(run, "doc_id string, label int, terms array<int>"), "terms"))


def with_toxicity(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """`docs` with a double column `name`, 0 to 1, of every whole text.

    Null texts score as empty ones: by the bias alone. A column already called `name` is replaced.
    """
    rows = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        place = model.place

        def of(text: str | None) -> np.ndarray:
            out: set[int] = set()
            for w in words_of(text):
                if (found := known.get(w)) is None:
                    found = known[w] = tuple(int(place[t]) for t in terms_of(w) if place[t] >= 0)
                if found:
                    out.update(found)
            return np.array(sorted(out), np.int64)

        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                scores = model.scores([of(t) for t in part.column("text").to_pylist()])
                if len(known) > REMEMBERED:
                    known.clear()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (name, "double")]))
