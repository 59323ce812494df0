"""Row-level comparison of two tables.

One null-safe full outer join on the id columns labels every row as inserted, changed, deleted
or unchanged. Everything else (layout, sparse form, change list, pairs) is a projection over
that join, so the plan is always two exchanges and one sort-merge join; tables bucketed by their ids skip
the exchanges.

Ids that repeat on both sides pair up with each other, as in any join; ``require_unique_ids``
rejects such input first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.names import backticks, drop_names, fold, free_prefix, has_name, is_case_sensitive, spelled_in
from framekit.operators.options import DiffMode, DiffOptions

_L, _R = "l", "r"


@dataclass(frozen=True)
class _Plan:
    """The columns of one comparison, resolved and checked."""

    left: DataFrame
    right: DataFrame
    ids: list[str]
    values: list[str]
    ignored: list[str]
    options: DiffOptions
    case_sensitive: bool

    def name(self, side: str, column: str) -> str | None:
        return spelled_in(self.left if side == _L else self.right, column, self.case_sensitive)

    def ref(self, side: str, column: str) -> Column | None:
        own = self.name(side, column)
        return None if own is None else F.col(f"{side}.{backticks(own)}")

    def data_type(self, column: str) -> T.DataType:
        return self.left.schema[self.name(_L, column)].dataType

    def prefixed(self, side: str, column: str) -> str:
        o = self.options
        return f"{o.left_prefix if side == _L else o.right_prefix}_{self.name(side, column)}"


def _listed(names: Sequence[str]) -> str:
    return ", ".join(names)


def _resolve(left: DataFrame, right: DataFrame, ids: Sequence[str], ignore: Sequence[str], options: DiffOptions) -> _Plan:
    cs = is_case_sensitive(left.sparkSession)
    options.check_case(cs)
    for side, df in (("left", left), ("right", right)):
        folded = [fold(c, cs) for c in df.columns]
        if twice := sorted({c for c in folded if folded.count(c) > 1}):
            raise ValueError(f"the {side} table has duplicate columns: {_listed(twice)}")
    l_cols, r_cols = drop_names(left.columns, ignore, cs), drop_names(right.columns, ignore, cs)
    if len(l_cols) != len(r_cols):
        raise ValueError(f"the tables have different numbers of compared columns:\nleft: {_listed(l_cols)}\nright: {_listed(r_cols)}")
    if not l_cols:
        raise ValueError("the tables have no columns to compare")
    typed = lambda df, cols: {(fold(c, cs), _nullable(df.schema[c].dataType).simpleString()) for c in cols}
    if (a := typed(left, l_cols)) != (b := typed(right, r_cols)):
        show = lambda s: _listed([f"{n} ({t})" for n, t in sorted(s)])
        raise ValueError(f"the tables have different columns\nleft only: {show(a - b)}\nright only: {show(b - a)}")
    ids = list(ids) or l_cols
    if missing := [c for c in ids if not has_name(c, l_cols, cs)]:
        raise ValueError(f"id columns do not exist among the compared columns: {_listed(missing)}")
    if missing := [c for c in ignore if not has_name(c, [*left.columns, *right.columns], cs)]:
        raise ValueError(f"ignored columns exist on neither side: {_listed(missing)}")
    if has_name(options.diff_column, ids, cs):
        raise ValueError(f"id columns must not contain the diff column name {options.diff_column!r}")
    if options.change_column is not None and has_name(options.change_column, ids, cs):
        raise ValueError(f"id columns must not contain the change column name {options.change_column!r}")
    plan = _Plan(left, right, [spelled_in(left, c, cs) for c in ids], drop_names(l_cols, ids, cs), list(ignore), options, cs)
    special = [options.diff_column, *([options.change_column] if options.change_column is not None else [])]
    if options.mode.one_sided:
        side = _L if options.mode is DiffMode.LEFT_SIDE else _R
        kept = [plan.name(side, c) for c in [*plan.values, *plan.ignored] if plan.name(side, c) is not None]
        if clash := [c for c in special if has_name(c, kept, cs)]:
            raise ValueError(f"value columns must not contain {_listed([repr(c) for c in clash])} in mode {options.mode.value}")
    else:
        made = [plan.prefixed(s, c) for s in (_L, _R) for c in [*plan.values, *plan.ignored] if plan.name(s, c) is not None]
        for what, names in (("diff or change column", special), ("id columns", plan.ids)):
            if clash := [c for c in names if has_name(c, made, cs)]:
                raise ValueError(f"prefixed value columns {_listed(made)} collide with the {what}: {_listed(clash)}")
    return plan


def _nullable(t: T.DataType) -> T.DataType:
    """The type with every inner value nullable, for comparison."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(_nullable(t.keyType), _nullable(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    return t


def _joined(p: _Plan, actions: frozenset[str] | None = None) -> tuple[DataFrame, Column, Column, Column]:
    """The join; whether the left and the right row exist; whether any value differs.

    ``actions``: the labels wanted, all by default. What they leave out is not joined: deleted rows alone are an anti join, rows of both
    sides an inner one.
    """
    mark = free_prefix([*p.left.columns, *p.right.columns]) + "exists"
    l, r = p.left.withColumn(mark, F.lit(1)).alias(_L), p.right.withColumn(mark, F.lit(1)).alias(_R)
    on = reduce(lambda a, b: a & b, (p.ref(_L, c).eqNullSafe(p.ref(_R, c)) for c in p.ids))
    changed = reduce(lambda a, b: a | b, (_differs(p, c) for c in p.values), F.lit(False))
    o = p.options
    left_only, right_only, both = (actions is None or bool(actions & set(labels)) for labels in ((o.delete_value,), (o.insert_value,), (o.change_value, o.nochange_value)))
    if left_only and not right_only and not both:
        # Columns of the other side are nulls, from a table without rows.
        joined = l.join(r, on, "left_anti").join(r.where(F.lit(False)), F.lit(True), "left")
    elif right_only and not left_only and not both:
        joined = r.join(l, on, "left_anti").join(l.where(F.lit(False)), F.lit(True), "left")
    else:
        how = {(True, True): "full_outer", (True, False): "left", (False, True): "right", (False, False): "inner"}[left_only, right_only]
        joined = l.join(r, on, how)
    return joined, F.col(f"{_L}.{mark}").isNotNull(), F.col(f"{_R}.{mark}").isNotNull(), changed


def _differs(p: _Plan, column: str) -> Column:
    equal = p.options.comparator_for(column, p.data_type(column)).equiv(p.ref(_L, column), p.ref(_R, column))
    return ~F.coalesce(equal, F.lit(False))


def _action(o: DiffOptions, has_left: Column, has_right: Column, changed: Column) -> Column:
    return F.when(~has_left, o.insert_value).when(~has_right, o.delete_value).when(changed, o.change_value).otherwise(o.nochange_value)


def _change_list(p: _Plan, has_left: Column, has_right: Column) -> Column:
    names = [F.when(_differs(p, c), F.lit(c)) for c in p.values]
    listed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return F.when(has_left & has_right, listed)


def _side(p: _Plan, side: str, column: str) -> Column:
    """A value, nulled in the sparse form where both sides are null-safely equal."""
    own, other = p.ref(side, column), p.ref(_R if side == _L else _L, column)
    comparable = other is not None and not _holds_map(p, column) and (
        p.left.schema[p.name(_L, column)].dataType == p.right.schema[p.name(_R, column)].dataType
    )
    return F.when(~own.eqNullSafe(other), own) if p.options.sparse and comparable else own


def _holds_map(p: _Plan, column: str) -> bool:
    return any("map<" in df.schema[n].dataType.simpleString() for df, n in ((p.left, p.name(_L, column)), (p.right, p.name(_R, column))) if n)


def _layout(p: _Plan) -> list[Column]:
    def own_order(side: str, cols: list[str]) -> list[str]:
        df = p.left if side == _L else p.right
        return sorted(cols, key=lambda c: df.columns.index(p.name(side, c)))

    def there(side: str, cols: Sequence[str]) -> list[str]:
        return [c for c in cols if p.name(side, c) is not None]

    def out(side: str, column: str) -> Column:
        return _side(p, side, column).alias(p.prefixed(side, column))

    if p.options.mode.one_sided:
        side = _L if p.options.mode is DiffMode.LEFT_SIDE else _R
        return [_side(p, side, c).alias(p.name(side, c)) for c in [*own_order(side, p.values), *own_order(side, there(side, p.ignored))]]
    if p.options.mode is DiffMode.SIDE_BY_SIDE:
        return [out(s, c) for s in (_L, _R) for c in [*own_order(s, p.values), *own_order(s, there(s, p.ignored))]]
    return [out(s, c) for c in [*p.values, *p.ignored] for s in (_L, _R) if p.name(s, c) is not None]


def _check_unique(df: DataFrame, ids: Sequence[str], side: str) -> None:
    if not df.groupBy(*[F.col(backticks(c)) for c in ids]).count().where("count > 1").isEmpty():
        raise ValueError(f"the {side} table has rows with equal ids {_listed(ids)}")


class Differ:
    """Comparison with fixed options."""

    def __init__(self, options: DiffOptions | None = None, require_unique_ids: bool = False) -> None:
        self.options = options or DiffOptions()
        self.require_unique_ids = require_unique_ids

    def _plan(self, left: DataFrame, right: DataFrame, ids: Sequence[str], ignore: Sequence[str]) -> _Plan:
        p = _resolve(left, right, ids, ignore, self.options)
        if self.require_unique_ids:
            _check_unique(left, p.ids, "left")
            _check_unique(right, [p.name(_R, c) for c in p.ids], "right")
        return p

    def diff(self, left: DataFrame, right: DataFrame, *ids: str, ignore: Sequence[str] = (), actions: Sequence[str] | None = None) -> DataFrame:
        """One row for each id: its action, the change list if asked for, ids and values of both sides.

        Without ids all compared columns are ids, and no row can be changed. Nulls in ids equal
        each other. Ignored columns are carried, not compared; they may exist on one side only.
        ``actions``: the labels of the rows wanted, all by default; rows of no such label are not joined where the ids tell.
        """
        p = self._plan(left, right, ids, ignore)
        o = p.options
        if actions is not None and (unknown := [a for a in actions if a not in o.labels]):
            raise ValueError(f"unknown actions {_listed(unknown)}; there are {_listed(o.labels)}")
        joined, has_left, has_right, changed = _joined(p, None if actions is None else frozenset(actions))
        change = [] if o.change_column is None else [_change_list(p, has_left, has_right).alias(o.change_column)]
        id_cols = [F.coalesce(p.ref(_L, c), p.ref(_R, c)).alias(c) for c in p.ids]
        out = joined.select(_action(o, has_left, has_right, changed).alias(o.diff_column), *change, *id_cols, *_layout(p))
        return out if actions is None else out.where(F.col(backticks(o.diff_column)).isin(list(actions)))

    def diff_with(self, left: DataFrame, right: DataFrame, *ids: str, ignore: Sequence[str] = ()) -> DataFrame:
        """Action plus the two rows as structs; the struct of a side without the row is null."""
        p = self._plan(left, right, ids, ignore)
        joined, has_left, has_right, changed = _joined(p)
        o = p.options

        def row(side: str, there: Column) -> Column:
            cols = [c for c in [*p.ids, *p.values, *p.ignored] if p.name(side, c) is not None]
            return F.when(there, F.struct(*[p.ref(side, c).alias(p.name(side, c)) for c in cols]))

        return joined.select(
            _action(o, has_left, has_right, changed).alias(o.diff_column), row(_L, has_left).alias(o.left_prefix), row(_R, has_right).alias(o.right_prefix)
        )

    def diff_as(self, schema: T.StructType, left: DataFrame, right: DataFrame, *ids: str, ignore: Sequence[str] = ()) -> DataFrame:
        """The comparison cast to a schema contract, whose columns must be a subset of the result's."""
        out = self.diff(left, right, *ids, ignore=ignore)
        cs = is_case_sensitive(left.sparkSession)
        if extra := drop_names(schema.fieldNames(), out.columns, cs):
            raise ValueError(f"the schema has columns that the comparison does not return: {_listed(extra)}")
        return out.select(*[F.col(backticks(c)) for c in schema.fieldNames()]).to(schema)

    def statistics(self, left: DataFrame, right: DataFrame, *ids: str, ignore: Sequence[str] = ()) -> DataFrame:
        """Number of rows of each action, ordered by action."""
        name = backticks(self.options.diff_column)
        return self.diff(left, right, *ids, ignore=ignore).groupBy(name).count().orderBy(name)

    def changes_only(self, left: DataFrame, right: DataFrame, *ids: str, ignore: Sequence[str] = ()) -> DataFrame:
        """Every row but the unchanged ones."""
        o = self.options
        return self.diff(left, right, *ids, ignore=ignore, actions=[o.insert_value, o.change_value, o.delete_value])


def diff(left: DataFrame, right: DataFrame, *ids: str, options: DiffOptions | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    return Differ(options).diff(left, right, *ids, ignore=ignore)


def diff_with(left: DataFrame, right: DataFrame, *ids: str, options: DiffOptions | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    return Differ(options).diff_with(left, right, *ids, ignore=ignore)


def diff_as(schema: T.StructType, left: DataFrame, right: DataFrame, *ids: str, options: DiffOptions | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    return Differ(options).diff_as(schema, left, right, *ids, ignore=ignore)


def against(right: DataFrame, *ids: str, options: DiffOptions | None = None, ignore: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """For ``left.transform(against(right, "id"))``."""
    return lambda left: Differ(options).diff(left, right, *ids, ignore=ignore)
