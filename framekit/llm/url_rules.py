"""URL rules by a sort-merge range join.

A host's labels in reverse order, each ended by a dot, form its key: ``www.example.net`` becomes
``net.example.www.``. A rule for a host and its subdomains is then the interval of keys that
start with the rule's key, and intervals nest or are disjoint. URLs sorted by key meet the sorted
rules in one sweep that keeps the stack of intervals open at the current key; at each level the
rule with the longest path that starts the URL's path is looked up. The longest of all wins.

Each task sorts its own URLs (Spark spills where needed), so URLs are never shuffled and one host may hold any
share of them. Rules are broadcast in sorted runs of at most ``RULES_AT_ONCE`` rules or ``CHARS_AT_ONCE`` characters (or one rule, if it
is longer); a longer list is swept run by run, with the table between two runs written to the shared folder, so memory does not grow with the list.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits an
empty host. Only A-Z are lower-cased. URLs of any length are read from end to end; equal URLs get equal verdicts, and repeated
rows stay. An empty table gives an empty table. Columns of the input are kept whatever their names, but for those with the names of the four that are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import columns, written
from framekit.names import backticks, free_prefix

ALLOW, BLOCK = "allow", "block"
#: Rules in one broadcast, and characters of their hosts and paths.
RULES_AT_ONCE, CHARS_AT_ONCE = 200_000, 50_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in (ALLOW, BLOCK) or not self.host:
            raise ValueError(f"bad rule {self}")

    @property
    def name(self) -> str:
        return self.host + self.path


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


class _Level:
    """An open interval: the rules of one host by path."""

    def __init__(self, key: str, rules: dict[str, Rule]) -> None:
        self.key, self.rules = key, rules
        self.lengths = sorted({len(p) for p in rules}, reverse=True)

    def best(self, path: str) -> Rule | None:
        return next((r for n in self.lengths if (r := self.rules.get(path[:n])) and len(r.path) == n), None)


def _levels(rules: Iterable[tuple[str, str, str]]) -> list[_Level]:
    by: dict[str, dict[str, Rule]] = {}
    for r in (Rule(*x) for x in rules):
        same = by.setdefault(host_key(r.host), {})
        # One rule may be listed twice; blocking wins.
        if r.path not in same or r.verdict == BLOCK:
            same[r.path] = r
    return [_Level(k, by[k]) for k in sorted(by)]


def sweep(levels: list[_Level], rows: Iterable[tuple[str, str]]) -> Iterator[Rule | None]:
    """The winning rule of each (key, path); keys must ascend in code point order."""
    stack: list[_Level] = []
    at = 0
    for key, path in rows:
        while at < len(levels) and levels[at].key <= key:
            while stack and not levels[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(levels[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        fits = [r for level in stack if (r := level.best(path)) is not None]
        yield max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def _runs(rules: Iterable[Rule]) -> Iterator[list[Rule]]:
    """The rules in the order of their keys, cut into runs."""
    run: list[Rule] = []
    chars = 0
    for r in sorted(rules, key=lambda r: (host_key(r.host), r.path)):
        if run and (len(run) == RULES_AT_ONCE or chars + len(r.name) > CHARS_AT_ONCE):
            yield run
            run, chars = [], 0
        run.append(r)
        chars += len(r.name)
    if run:
        yield run


def _swept(df: DataFrame, rules: list[Rule], names: dict[str, str]) -> DataFrame:
    """Add the best of these rules to a table with key and path, keeping a better one found before; ``names`` of its own columns."""
    shared = df.sparkSession.sparkContext.broadcast([(r.verdict, r.host, r.path) for r in rules])
    found_ = [names[n] for n in ("rule", "verdict", "rule_host")]

    def run(batches):
        import pyarrow as pa

        def keys():
            for batch in batches:
                # A batch without rows would never be reached from its first one.
                if batch.num_rows:
                    ahead.append(batch)
                    yield from zip(batch.column(names["key"]).to_pylist(), batch.column(names["path"]).to_pylist(), strict=True)

        ahead: list = []
        found = sweep(_levels(shared.value), keys())
        for first in found:
            batch = ahead.pop(0)
            best = [first, *(next(found) for _ in range(batch.num_rows - 1))]
            old = zip(*(batch.column(n).to_pylist() for n in found_), strict=True)
            new = [o if r is None or (o[0] is not None and (len(o[0]), len(o[2])) > (len(r.name), len(r.host))) else (r.name, r.verdict, r.host) for r, o in zip(best, old, strict=True)]
            cols = dict(zip(found_, zip(*new, strict=True), strict=True))
            arrays = [pa.array(cols[n], pa.string()) if n in cols else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    # Code point order of Python's strings is the byte order of Spark's.
    return df.sortWithinPartitions(names["key"]).mapInArrow(run, df.schema)


def judge(df: DataFrame, url: str, rules: Iterable[Rule], default: str = ALLOW, keep: Iterable[str] | None = None) -> DataFrame:
    """Append host, path, the winning rule and its verdict (``default`` where no rule fits).

    ``keep``: columns of the input to carry along; all by default.
    """
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    mark = free_prefix([*df.columns, *made])
    names = {n: mark + n for n in (*made, "key", "rule_host")}
    at = F.col(backticks(url))
    # Functions over Arrow batches look columns up by name, so these are plain on the way.
    plain = [f"{mark}{i}" for i in range(len(kept))]
    out = df.select(*(c.alias(n) for c, n in zip(columns(df, kept), plain, strict=True)), host_of(at).alias(names["host"]), path_of(at).alias(names["path"]))
    none = F.lit(None).cast("string")
    reverse = F.concat(F.array_join(F.reverse(F.split(names["host"], r"\.", -1)), "."), F.lit("."))
    out = out.select("*", reverse.alias(names["key"]), *(none.alias(names[n]) for n in ("rule", "verdict", "rule_host")))
    for i, part in enumerate(_runs(rules)):
        out = _swept(out if i == 0 else written(out, "urls"), part, names)
    verdict = F.coalesce(names["verdict"], F.lit(default)).alias("verdict")
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, plain, strict=True)), *(F.col(names[n]).alias(n) for n in ("host", "path", "rule")), verdict)
