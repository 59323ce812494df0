"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean over its words' character n-grams of hashed embeddings; a linear layer and a softmax give
the languages' probabilities. Plain stochastic gradient descent in numpy trains both on a
bounded sample of labelled texts (``SAMPLE_DOCS`` documents, each as a whole, in every language that they have); a
temperature is fitted and a rejection threshold chosen on a part held out from that sample. The texts are read where
they lie: only counts of hashed n-grams leave the executors, at most ``BUCKETS`` for a text of any length.

Since the model is linear before the softmax, each n-gram's contribution to the logits is a table row,
and each word's sum is kept in a bounded cache: whole texts of any length are scored in one pass
with memory that does not depend on the text's words.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text
where nothing was learned, and an empty table gives an empty table. Rows are judged on their text alone, so copies agree. A text
in no learned language still gets the likeliest, with ``rejected`` set. Texts and words of any length are read from end to
end. Kept columns keep their names, but for those that are added, which replace them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import append_columns, hashable, sample_in_place
from framekit.names import backticks

UNDETERMINED = "und"
BUCKETS, WIDTH = 1 << 15, 16
#: Documents that training may read.
SAMPLE_DOCS = 4000
EPOCHS, RATE, BATCH = 5, 4.0, 16
#: Texts that training looks at in all epochs, at least: a small sample is gone through more often.
VISITS = 8_000
#: Share of held-out texts in learned languages that rejection keeps.
KEEP = 0.99
_CACHE = 200_000
#: Longer words are cut into pieces, so that no word is hashed at quadratic cost or kept whole.
_PIECE = 32
_NO_LETTER = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text[:200])) or bool(text) and any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _NO_LETTER.sub(" ", text.lower()).split()


class Grams(dict):
    """Buckets of n-grams, kept for reuse up to a bound."""

    def __missing__(self, gram: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[gram] = bucket = _bucket(gram)
        return bucket


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf8", "replace")) % BUCKETS


def grams_of(word: str, known: Grams) -> list[int]:
    """Hashed n-grams of 2 to 4 characters of the word between its boundary marks, and the word itself."""
    out: list[int] = []
    for at in range(0, len(word), _PIECE):
        marked = f"<{word[at : at + _PIECE]}>"
        out += [known[marked[i : i + n]] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
        out.append(_bucket(marked))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: BUCKETS x languages: each n-gram's part of the logits.
    parts: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


class Scorer:
    """Scores texts under a model, with a bounded cache of words."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._grams = Grams()
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._sums = np.zeros((1024, len(self.model.languages) + 1), np.float32)

    def _learn(self, word: str) -> int:
        grams = grams_of(word, self._grams)
        at = len(self._index)
        if at == len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        self._sums[at, :-1] = self.model.parts[grams].sum(axis=0)
        self._sums[at, -1] = len(grams)
        self._index[word] = at
        return at

    def logits(self, text: str) -> np.ndarray | None:
        words = words_of(text)
        if not words:
            return None
        if len(self._index) > _CACHE:
            self._clear()
        total = np.zeros(len(self.model.languages) + 1)
        # Very long texts go in slices, so that new words cannot outgrow the cache by much.
        for i in range(0, len(words), 50_000):
            ids = [self._index.get(w, -1) for w in words[i : i + 50_000]]
            if -1 in ids:
                ids = [self._index[w] if w in self._index else self._learn(w) for w in words[i : i + 50_000]]
            total += self._sums[ids].sum(axis=0, dtype=np.float64)
            if len(self._index) > 2 * _CACHE:
                self._clear()
        return (total[:-1] / total[-1] + self.model.bias) / self.model.temperature

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The likeliest language, its probability, and whether it is below the rejection threshold."""
        if not self.model.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        z = self.logits(text)
        if z is None:
            return UNDETERMINED, 0.0, True
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(p[best] < self.model.reject_below)


def bag_of(text: str, cache: dict[str, list[int]], known: Grams) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, ascending, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for word, n in Counter(words_of(text)).items():
        grams = cache.get(word)
        if grams is None:
            if len(cache) > _CACHE // 4:
                cache.clear()
            grams = cache[word] = grams_of(word, known)
        np.add.at(total, grams, n)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def fit(examples: Sequence[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> LanguageModel:
    """Train on (buckets, counts, language) of texts."""
    examples = [e for e in examples if len(e[0])]
    languages = sorted({lang for _, _, lang in examples})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    place = {lang: i for i, lang in enumerate(languages)}
    bags, ys = [e[0] for e in examples], [place[e[2]] for e in examples]
    # Each bucket's share of its text.
    shares = [(e[1] / e[1].sum()).astype(np.float32) for e in examples]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = order[: len(bags) // 5] if len(bags) >= 50 else order[:0]
    train = order[len(held) :]
    k = len(languages)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias, y = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32), np.array(ys)
    batches, epochs = -(-len(train) // BATCH), max(EPOCHS, -(-VISITS // len(train)))
    for epoch in range(epochs):
        rng.shuffle(train)
        for b in range(batches):
            rate = RATE * (1 - (epoch * batches + b) / (epochs * batches))
            rows = train[b * BATCH : (b + 1) * BATCH]
            sizes = np.array([len(bags[i]) for i in rows])
            ids, at = np.concatenate([bags[i] for i in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            share = np.concatenate([shares[i] for i in rows])[:, None]
            mean = np.add.reduceat(emb[ids] * share, at, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            # Damped by what a step would change in the logits, so that texts of few n-grams cannot make it overshoot.
            turn = 1 + rate * np.add.reduceat(share * share, at, axis=0) * (out * out).sum()
            step = np.repeat(p @ out.T / turn, sizes, axis=0) * share
            out -= rate * (mean.T @ p) / (len(rows) ** 0.5 * (1 + rate * (mean * mean).sum(axis=1).mean()))
            bias -= 0.1 * rate * p.mean(axis=0)
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, step[:, j], len(touched)) for j in range(WIDTH)], axis=1)
            emb[touched] -= (rate * grad).astype(np.float32)
    parts = emb @ out
    z = np.array([shares[i] @ parts[bags[i]] + bias for i in held]) if len(held) else np.zeros((0, k))
    temperature, reject = 1.0, 0.0
    if len(held):
        def top(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        loss = lambda t: -np.log(np.maximum(top(t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        temperature = min((0.25 * 1.15**i for i in range(25)), key=loss)
        reject = min(0.99, float(np.quantile(top(temperature).max(axis=1), 1 - KEEP)))
    return LanguageModel(languages, parts.astype(np.float32), bias.astype(np.float64), float(temperature), reject)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on a bounded sample of rows with a language; the texts are counted on the executors."""
    # By whole rows: a text with very many copies counts by its share and cannot fill the sample.
    t, by = F.col(backticks(text)), F.col(backticks(lang))
    labelled = docs.where(t.isNotNull() & by.isNotNull())
    some = sample_in_place(labelled, hashable(labelled), sample_docs).select(t.alias("text"), by.cast("string").alias("lang"))

    def count(batches):
        import pyarrow as pa

        cache, known = {}, Grams()
        for batch in batches:
            bags = [bag_of(x, cache, known) for x in batch.column("text").to_pylist()]
            ids, n = (pa.array([b[i].astype(kind).tobytes() for b in bags], pa.binary()) for i, kind in ((0, "<u2"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([ids, n, batch.column("lang")], names=["ids", "n", "lang"])

    rows = some.mapInArrow(count, "ids binary, n binary, lang string").collect()
    ordered = sorted((bytes(r["ids"]), bytes(r["n"]), r["lang"]) for r in rows)
    return fit([(np.frombuffer(i, "<u2").astype(np.int32), np.frombuffer(n, "<f4").astype(np.float64), by) for i, n, by in ordered])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Append lang_pred, score and rejected to the kept columns (all by default)."""
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.parts, model.bias, model.temperature, model.reject_below))

    def start():
        import pyarrow as pa

        scorer = Scorer(LanguageModel(*shared.value))

        def compute(texts):
            cols = list(zip(*map(scorer.predict, texts), strict=True)) or [(), (), ()]
            return [pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)]

        return compute

    return append_columns(docs, keep, F.col(backticks(text)), made, start)
