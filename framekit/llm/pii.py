"""Personal data: candidate spans scored by boosted trees.

Base patterns find the plain forms of emails, IP addresses, card numbers and phone numbers; these
always count. High-recall generators then propose overlapping spans of disguised or unusual forms
(``name (at) host (dot) org``, numbers with other separators, phones without ``+``). Each candidate is
brought to canonical form and described by its format and context; boosted trees,
trained on the base spans against candidates that no reading of the base patterns admits, score
it, and a threshold for each kind, set for precision on held-out candidates, selects what is added.

Training reads a bounded sample of documents (``SAMPLE_DOCS`` with a digit or an at sign) and of their candidates
(``SAMPLE_CANDIDATES``); scoring covers every whole text. All matching is linear in the text.

Defined results: a null text is the empty text, with no spans. Without enough candidates of both classes, as on an empty table,
nothing is added. Added spans overlap no base span and each other never. Offsets count code points. Equal texts get equal spans and
repeated rows stay. Columns of the input are kept whatever their names and types, but for one that has the output's name, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.boosting import BoostedTrees
from framekit.llm.common import Scratch, append_columns, hashable, hashed_sample, sample_in_place
from framekit.names import backticks

KINDS = ("email", "ip", "card", "phone")
#: Documents that training may read, candidates that it learns from at most, and at least.
SAMPLE_DOCS, SAMPLE_CANDIDATES, LEAST_CANDIDATES = 6000, 60_000, 50
#: Precision that the thresholds keep on held-out candidates.
PRECISION = 0.98

Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEEN = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The part before an at sign holds none, so it ends at the sign before or the match before.
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(_LOCAL))
        last = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches for each kind that pass its test, by kind, then start."""
    found: list[Span] = [("email", *s) for s in _emails(text)]
    for part in _DOTTED.finditer(text):
        if part[0].count(".") >= 3:
            found += [("ip", *m.span()) for m in _IP.finditer(text, *part.span()) if all(len(o := x.lstrip("0")) <= 3 and int(o or 0) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# Candidates

_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?", re.IGNORECASE)
_DOT = re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?", re.IGNORECASE)
_DOT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_ANY_IP = re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)[0-9]{1,4}){3}", re.IGNORECASE)
_ANY_CARD = re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){12,}")
_ANY_PHONE = re.compile(r"(?:\+\s?|\(\s?)?[0-9][0-9\x20()./-]{5,}[0-9]")


#: Digits of a run of numbers that is taken for a table when training.
_TABLE = 40
_GROUP = re.compile(r"[0-9]+")


def _digit_spans(text: str, start: int, end: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """The span, or if it has more digits than ``most``, every part of it between two groups of digits that has at most as many and ``least``."""
    n = len(_digits(text[start:end]))
    if n <= most:
        if n >= least:
            yield start, end
        return
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    for i, (s, _) in enumerate(groups):
        total = 0
        while s > start and text[s - 1] in "(+":
            s -= 1
        for a, e in groups[i : i + most]:
            total += e - a
            if total > most:
                break
            if total >= least:
                yield s, e


def candidates(text: str) -> list[Span]:
    """Overlapping spans of any shape that might be personal data."""
    found: list[Span] = [("email", *s) for s in _emails(text)]
    last = 0
    for m in _AT.finditer(text):
        # Brackets are no part of a name, so this goes back to the match before at most.
        start = last + len(text[last : m.start()].rstrip(_LOCAL))
        last = m.end()
        if start < m.start() and (d := _DOT_DOMAIN.match(text, m.end())):
            found.append(("email", start, d.end()))
    found += [("ip", *m.span()) for m in _ANY_IP.finditer(text)]
    found += [("card", *s) for m in _ANY_CARD.finditer(text) for s in _digit_spans(text, *m.span(), 13, 19)]
    found += [("phone", *s) for m in _ANY_PHONE.finditer(text) for s in _digit_spans(text, *m.span(), 7, 16)]
    return found


def _tables(text: str) -> _Taken:
    """Where numbers stand in long runs."""
    return _Taken([m.span() for m in _ANY_PHONE.finditer(text) if len(_digits(m[0])) > _TABLE])


def canonical(kind: str, span: str) -> str:
    """The plain form that a disguised span stands for."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", span))
    if kind == "ip":
        return _DOT.sub(".", span)
    if kind == "card":
        return re.sub(r"[._/\x20-]+", "-", span)
    return span


_NEAR = {
    "email": re.compile(r"mail|contact|write|address", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|from", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|pay", re.IGNORECASE),
    "phone": re.compile(r"tel|phone|call|fax|mobile|contact", re.IGNORECASE),
}
_TECHNICAL = re.compile(r"version|\bv\.?\s?$|release|token|key|hash|isbn|order|invoice|licen[sc]e|\bid\b", re.IGNORECASE)


def features(text: str, span: Span) -> list[float]:
    """Format of the canonical form, and what stands around the span."""
    kind, start, end = span
    raw = text[start:end]
    plain = canonical(kind, raw)
    digits = _digits(plain)
    groups = [len(g) for g in re.findall(r"[0-9]+", plain)]
    seps = re.findall(r"[^0-9A-Za-z]+", plain)
    before, after = text[max(0, start - 30) : start], text[end : end + 30]
    octets = plain.split(".") if kind == "ip" else []
    domain = plain.rpartition("@")[2] if kind == "email" else ""
    return [
        *(float(kind == k) for k in KINDS),
        len(plain),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        len(seps),
        len(set(seps)),
        max(map(len, seps), default=0),
        float(luhn(digits)) if 12 < len(digits) < 20 else -1.0,
        float(plain.startswith("+")),
        float("(" in plain) + float(")" in plain),
        float(len(octets) == 4 and all(o.isdigit() and int(o) <= 255 for o in octets)),
        float(any(len(o) > 1 and o[0] == "0" for o in octets)),
        domain.count("."),
        len(domain.rpartition(".")[2]),
        float(domain.rpartition(".")[2].isalpha()),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in tuple(".-_/=:\"'")) if before else 0.0,
        float(after[:1] in tuple("-_/=:\"'%")) if after else 0.0,
        float(bool(_NEAR[kind].search(before))),
        float(bool(_TECHNICAL.search(before))),
        sum(map(str.isdigit, before)),
        sum(map(str.isdigit, after)),
    ]


class _Taken:
    """Spans as sorted intervals that do not overlap."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self._at: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if self._at and s < self._at[-1][1]:
                self._at[-1] = (self._at[-1][0], max(e, self._at[-1][1]))
            else:
                self._at.append((s, e))

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self._at, (start, end))
        return (i == 0 or self._at[i - 1][1] <= start) and (i == len(self._at) or end <= self._at[i][0])

    def take(self, start: int, end: int) -> None:
        insort(self._at, (start, end))

    def nests(self, start: int, end: int) -> bool:
        """Whether an interval lies in the span or the span in one."""
        i = bisect_left(self._at, (start,))
        return (i > 0 and self._at[i - 1][1] >= end) or (i < len(self._at) and (self._at[i][0] == start or self._at[i][1] <= end))


def _label(text: str, span: Span, base: dict[str, _Taken], tables: _Taken) -> float | None:
    """1: a base span of the kind lies in it or it in one; 0: part of a table, or not even its canonical form has one; else unknown."""
    kind, start, end = span
    if base[kind].nests(start, end):
        return 1.0
    if not tables.free(start, end):
        return 0.0
    plain = canonical(kind, text[start:end])
    tries = [plain, "+" + plain.lstrip("+ ")] if kind == "phone" else [plain]
    if kind == "phone":
        grouped = [len(g) for g in re.findall(r"[0-9]+", plain)]
        if len(grouped) < 3 or "." in plain:
            return 0.0
    return None if any(k == kind for t in tries for k, _, _ in base_spans(t)) else 0.0


def _disguised(kind: str, span: str) -> str | None:
    """A base span as people hide it; training learns from these as well."""
    if kind == "email":
        return span.replace("@", " (at) ")
    if kind == "ip":
        return "[.]".join(span.split("."))
    if kind == "card":
        digits = _digits(span)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    bare = re.sub(r"\A\+[0-9]{1,3}[\x20.-]+(?=[(0-9])", "", span)
    return bare if bare != span and 7 <= len(_digits(bare)) else None


def _valid(kind: str, span: str) -> bool:
    """Whether the canonical form reads as a base span; what does not is never selected."""
    plain = canonical(kind, span)
    tries = [plain, "+1 " + plain.lstrip("+ ")] if kind == "phone" else [plain]
    return any(k == kind for t in tries for k, _, _ in base_spans(t))


@dataclass(frozen=True)
class PiiModel:
    """The trees and each kind's threshold; ``trees`` is None where training found too little."""

    trees: BoostedTrees | None
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[tuple[Span, float]]:
        taken = _Taken([(s, e) for _, s, e in base])
        new = [c for c in candidates(text) if taken.free(c[1], c[2]) and _valid(c[0], text[c[1] : c[2]])]
        if self.trees is None or not new:
            return []
        p = self.trees.probability(np.array([features(text, c) for c in new]))
        out = []
        for i in sorted(range(len(new)), key=lambda i: (-p[i], new[i])):
            kind, s, e = new[i]
            if p[i] >= self.thresholds[kind] and taken.free(s, e):
                taken.take(s, e)
                out.append((new[i], float(p[i])))
        return out

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans, by kind and start."""
        if not text or not _SEEN.search(text):
            return [], []
        base = base_spans(text)
        order = lambda spans: sorted(set(spans), key=lambda x: (KINDS.index(x[0]), x[1:]))
        return order(base), order([*base, *(s for s, _ in self.added(text, base))])


_FEATURES = "hash long, kind string, y double, x array<double>"


def _training_rows(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                base = base_spans(t)
                own_kind = {k: _Taken([(s, e) for x, s, e in base if x == k]) for k in KINDS}
                tables = _tables(t)
                labelled = [(t, c, _label(t, c, own_kind, tables)) for c in candidates(t)]
                for kind, s, e in base:
                    if hidden := _disguised(kind, t[s:e]):
                        lo = max(0, s - 40)
                        labelled.append((t[lo:s] + hidden + t[e : e + 40], (kind, s - lo, s - lo + len(hidden)), 1.0))
                for own, c, y in labelled:
                    if y is not None:
                        key = hashlib.blake2b(f"{c[1]}:{own[max(0, c[1] - 20) : c[2]]}".encode("utf8", "replace"), digest_size=7).digest()
                        rows.append({"hash": int.from_bytes(key, "big"), "kind": c[0], "y": y, "x": features(own, c)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("hash", pa.int64()), ("kind", pa.string()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))]))

    return docs.select(F.col(backticks(text)).alias("t")).mapInArrow(run, _FEATURES)


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> PiiModel:
    own = F.col(backticks(text))
    some = docs.where(own.rlike(r"[0-9@]|[\[({]\s?[aA][tT]\s?[\])}]"))
    with Scratch(docs.sparkSession) as scratch:
        # By whole rows, so that a text with very many copies cannot fill the sample.
        found = scratch.write(_training_rows(sample_in_place(some, hashable(some), sample_docs), text), "candidates")
        rows = sorted(tuple(r) for r in hashed_sample(found, ["hash", "x"], sample_candidates).collect())
    y = np.array([r[2] for r in rows])
    if len(rows) < LEAST_CANDIDATES or y.min() == y.max():
        return PiiModel(None, {})
    x, kind, held = np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] % 4 == 0 for r in rows])
    if not 0 < y[~held].mean() < 1 or not held.any():
        return PiiModel(None, {})
    trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, thresholds = trees.probability(x[held]), {}
    for k in KINDS:
        own = kind[held] == k
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.arange(own.sum()) >= 4))
        ranked = np.append(p[own][order], 0.0)
        # Halfway to the next lower candidate.
        thresholds[k] = max(0.5, float(ranked[good[-1] : good[-1] + 2].mean())) if len(good) else 2.0
    return PiiModel(trees, thresholds)


def find(docs: DataFrame, model: PiiModel, text: str = "text", name: str = "spans", keep: Sequence[str] | None = None) -> DataFrame:
    """Append all spans of each text as structs (kind, start, end, base), by kind, then start, to the kept columns (all by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(_plain_model(model))
    span = T.StructType.fromDDL("kind string, start int, end int, base boolean")

    def start():
        import pyarrow as pa

        ready = _model_of(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

        def one(t):
            base, every = ready.spans(t)
            plain = set(base)
            return [{"kind": k, "start": s, "end": e, "base": (k, s, e) in plain} for k, s, e in every]

        return lambda texts: [pa.array(list(map(one, texts)), kind)]

    return append_columns(docs, keep, F.col(backticks(text)), [T.StructField(name, T.ArrayType(span))], start)


def _plain_model(m: PiiModel) -> tuple:
    return (None if m.trees is None else m.trees.__dict__, m.thresholds)


def _model_of(plain: tuple) -> PiiModel:
    trees = None
    if plain[0] is not None:
        trees = BoostedTrees()
        trees.__dict__.update(plain[0])
    return PiiModel(trees, plain[1])


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans merge under the first's kind."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
