"""Text quality from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each text. Only the vote patterns are
aggregated over all texts, at most 3 ** 8 of them; expectation-maximisation on their counts
estimates how each labeller votes on good and on bad texts, and with that the posterior of each pattern. The posterior
labels of a bounded sample (``SAMPLE_DOCS``) train a linear scorer over hashed words and word shapes,
which then scores every whole text.

Labellers that look at the same defect would count it twice, as expectation-maximisation takes them to be independent given the
class; so each reads another property of the text, and every known defect shows in two properties at least.

Defined results: a null text, or one without a word, has no votes, posterior and score 0, and is
rejected. Equal texts get equal scores, repeated rows stay. Where the sample is empty or of one class, the score is the posterior; an
empty table gives an empty table. Texts and words of any length are read from end to end. Kept columns keep their names, but for
those that are added, which replace them.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import append_columns, hashable, sample_in_place
from framekit.names import backticks

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Documents that train the scorer, and the scorer's hashed features.
SAMPLE_DOCS, FEATURES = 5000, 1 << 12
KEEP_FROM = 0.5
_CACHE = 100_000
#: Longer words count as pieces of so many bytes, so that a text without blanks is scored from end to end.
_PIECE = 64

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_ODD = bytes(c for c in range(33, 127) if c not in _LETTERS and not 48 <= c <= 57 and c not in b".,'!?|-\":;()")
#: What words of prose don't end in.
_NO_ENDS = _ODD + b"|-"


def _but(data: bytes, drop: bytes) -> int:
    """The number of bytes among ``drop``."""
    return len(data) - len(data.translate(None, drop))


def _vote(value: float, good_below: float, bad_above: float) -> int:
    return GOOD if value <= good_below else BAD if value > bad_above else ABSTAIN


def votes(text: bytes) -> tuple[int, ...]:
    """One vote of each labeller on a text with words: repeats, symbols, capitals, menus, shouting, variety, word ends, lines.

    They abstain on texts too short to tell.
    """
    words = text.split()
    n, letters, lines = len(words), _but(text, _LETTERS), text.split(b"\n")
    odd, pipes, shouts = _but(text, _ODD), text.count(b"|"), text.count(b"!")
    return (
        _vote(sum(map(operator.eq, words, words[1:])) / n, 0.05, 0.15) if n >= 4 else ABSTAIN,
        _vote(odd / n, 0.1, 0.3),
        _vote(_but(text, _UPPER) / letters, 0.2, 0.5) if letters >= 20 else ABSTAIN,
        _vote(pipes / n, 0.0, 0.15),
        _vote(shouts / n, 0.05, 0.3),
        _vote(-len(set(words)) / n, -0.5, -0.3) if n >= 20 else ABSTAIN,
        _vote(sum(w[-1] in _NO_ENDS for w in words) / n, 0.05, 0.15) if n >= 4 else ABSTAIN,
        _vote(1 - len(set(lines)) / len(lines), 0.34, 0.5) if len(lines) >= 4 else ABSTAIN,
    )


LABELLERS = 8


def pattern_of(text: bytes | None) -> int | None:
    """The votes as a number in base 3."""
    if not text or not text.split(None, 1):
        return None
    out = 0
    for v in votes(text):
        out = 3 * out + v
    return out


def _unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**j % 3 for j in reversed(range(LABELLERS))], axis=1)


@dataclass
class LabelModel:
    #: Labeller x class x vote probabilities where it votes, and the share of good texts.
    rates: np.ndarray
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = _unpacked(np.asarray(patterns, np.int64))
        # Abstaining says nothing: it depends on the text's length.
        told = np.log(self.rates[np.arange(LABELLERS)[None, :], :, np.minimum(v, 1)]) * (v != ABSTAIN)[:, :, None]
        log = told.sum(axis=1) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        right = self.rates[:, GOOD, GOOD] * self.good + self.rates[:, BAD, BAD] * (1 - self.good)
        wrong = self.rates[:, GOOD, BAD] * self.good + self.rates[:, BAD, GOOD] * (1 - self.good)
        return right / (right + wrong)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """From the counts of vote patterns; starts from "bad if anyone says so"."""
    v = _unpacked(patterns)
    p = np.where((v == BAD).any(axis=1), 0.1, 0.95)
    model = None
    for _ in range(rounds):
        rates = np.empty((LABELLERS, 2, 2))
        for y, w in ((GOOD, p), (BAD, 1 - p)):
            for j in range(LABELLERS):
                seen = np.bincount(v[:, j], w * counts, 3)[:2] + 0.5
                rates[j, y] = seen / seen.sum()
        model = LabelModel(rates, float(np.clip((p * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4)))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


# The scorer

_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Ids(dict):
    """Word to its hashed word feature and shape feature, in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_CLASSES))
        out = zlib.crc32(word.lower()) % FEATURES | zlib.crc32(b"\0" + shape) % FEATURES << 16
        self[word] = out
        return out


def _flag(name: str) -> int:
    return zlib.crc32(b"\1" + name.encode()) % FEATURES


def featurise(text: bytes, ids: _Ids) -> np.ndarray:
    """Square roots of the words', shapes' and repeats' shares in hashed places."""
    words = text.split()
    if max(map(len, words)) > _PIECE:
        words = [w[i : i + _PIECE] for w in words for i in range(0, len(w), _PIECE)]
    n = len(words)
    total = np.zeros(2 * FEATURES)
    for i in range(0, n, 100_000):
        both = np.array([ids[w] for w in words[i : i + 100_000]], np.int64)
        total[:FEATURES] += np.bincount(both & 0xFFFF, minlength=FEATURES)
        total[FEATURES:] += np.bincount(both >> 16, minlength=FEATURES)
    x = np.sqrt(total[:FEATURES] / n) + 2 * np.sqrt(total[FEATURES:] / n)
    x[_flag("same")] += 4 * np.sqrt(sum(map(operator.eq, words, words[1:])) / n)
    if n >= 20:
        x[_flag(f"variety{int(8 * len(set(words)) / n)}")] += 2
    return x.astype(np.float32)


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam; classes weigh the same. The last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = float(np.clip(p.mean(), 0.01, 0.99))
    weight = p / (2 * share) + (1 - p) / (2 * (1 - share))
    w, m, s = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    p, weight = p.astype(np.float32), weight.astype(np.float32)
    for t in range(1, rounds + 1):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p) * weight) / len(x) + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    labels: LabelModel | None
    weights: np.ndarray | None


def _binary(text: str) -> Column:
    return F.col(backticks(text)).cast("binary")


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all texts with words."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(3**LABELLERS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if (p := pattern_of(t)) is not None:
                    total[p] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pattern", "n"])

    return docs.select(_binary(text).alias("t")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    counted = sorted((r["pattern"], r["n"]) for r in vote_counts(docs, text).collect())
    if not counted:
        return QualityModel(None, None)
    labels = expectation_maximisation(*map(np.array, zip(*counted, strict=True)))

    def run(batches):
        import pyarrow as pa

        ids = _Ids()
        for batch in batches:
            rows = [(p, np.flatnonzero(x := featurise(t, ids)), x) for t in batch.column(0).to_pylist() if (p := pattern_of(t)) is not None]
            cols = ([r[0] for r in rows], [r[1].astype(np.int32) for r in rows], [r[2][r[1]] for r in rows])
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pattern", "at", "x"])

    # By whole rows: a text with very many copies counts by its share and cannot fill the sample. Texts are read where they lie; features leave.
    some = sample_in_place(docs.where(F.col(backticks(text)).isNotNull()), hashable(docs), sample_docs).select(_binary(text).alias("t"))
    rows = some.mapInArrow(run, "pattern long, at array<int>, x array<float>").toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["pattern"][i], rows["at"][i].tobytes() if hasattr(rows["at"][i], "tobytes") else str(rows["at"][i])))]
    p = labels.posterior(rows["pattern"].to_numpy()) if len(rows) else np.zeros(0)
    if not len(p) or (p > 0.5).all() or (p <= 0.5).all():
        return QualityModel(labels, None)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, at] = v
    return QualityModel(labels, fit_linear(x, p))


def classify(docs: DataFrame, model: QualityModel, text: str = "text", keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Append posterior (of the votes), score and accepted, their names after the prefix, to the kept columns (all by default)."""
    made = [T.StructField(prefix + n, kind) for n, kind in (("posterior", T.DoubleType()), ("score", T.DoubleType()), ("accepted", T.BooleanType()))]
    labels, weights = model.labels, model.weights
    shared = docs.sparkSession.sparkContext.broadcast((None if labels is None else (labels.rates, labels.good), weights))

    def start():
        import pyarrow as pa

        plain, w = shared.value
        ids, of = _Ids(), LabelModel(*plain) if plain else None

        # Every pattern's posterior, once.
        of_pattern = None if of is None else of.posterior(np.arange(3**LABELLERS))

        def one(data):
            p = pattern_of(data)
            if p is None or of is None:
                return 0.0, 0.0
            posterior = float(of_pattern[p])
            if w is None:
                return posterior, posterior
            return posterior, float(1 / (1 + np.exp(-np.clip(featurise(data, ids) @ w[:-1] + w[-1], -30, 30))))

        def compute(texts):
            post, score = np.array(list(map(one, texts)), np.float64).reshape(-1, 2).T
            return [pa.array(post), pa.array(score), pa.array(score >= KEEP_FROM)]

        return compute

    return append_columns(docs, keep, _binary(text), made, start)
