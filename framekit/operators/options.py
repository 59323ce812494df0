"""Immutable, validated options of the table comparison."""

from __future__ import annotations

import dataclasses
import enum
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from framekit.names import fold
from framekit.operators.comparators import Comparator, NullSafeEqual, as_comparator


class DiffMode(enum.Enum):
    """How the value columns of both sides are laid out."""

    COLUMN_BY_COLUMN = "column-by-column"
    SIDE_BY_SIDE = "side-by-side"
    LEFT_SIDE = "left-side"
    RIGHT_SIDE = "right-side"
    DEFAULT = "column-by-column"

    @classmethod
    def by_name(cls, name: str) -> DiffMode:
        """By value (``side-by-side``) or member name in any case (``SideBySide``, ``default``)."""
        plain = name.replace("-", "").replace("_", "").lower()
        for key, mode in cls.__members__.items():
            if plain in (key.replace("_", "").lower(), mode.value.replace("-", "")):
                return mode
        raise ValueError(f"unknown diff mode {name!r}; one of {', '.join(m.value for m in cls)}")

    @property
    def one_sided(self) -> bool:
        return self in (DiffMode.LEFT_SIDE, DiffMode.RIGHT_SIDE)


@dataclass(frozen=True)
class DiffOptions:
    diff_column: str = "diff"
    left_prefix: str = "left"
    right_prefix: str = "right"
    insert_value: str = "I"
    change_value: str = "C"
    delete_value: str = "D"
    nochange_value: str = "N"
    change_column: str | None = None
    mode: DiffMode = DiffMode.COLUMN_BY_COLUMN
    sparse: bool = False
    default_comparator: Comparator = NullSafeEqual()
    type_comparators: Mapping[T.DataType, Comparator] = field(default_factory=dict)
    name_comparators: Mapping[str, Comparator] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.left_prefix or not self.right_prefix:
            raise ValueError("left and right prefix must not be empty")
        labels = self.labels
        if len(set(labels)) != len(labels):
            raise ValueError(f"diff labels must be distinct: {', '.join(labels)}")
        if self.change_column is not None and self.change_column == self.diff_column:
            raise ValueError(f"change column must differ from the diff column: {self.diff_column}")
        self.check_case(True)

    @property
    def labels(self) -> tuple[str, str, str, str]:
        return self.insert_value, self.change_value, self.delete_value, self.nochange_value

    def check_case(self, case_sensitive: bool) -> None:
        """Prefixes, and the two special columns, must differ under the session's case rule."""
        if fold(self.left_prefix, case_sensitive) == fold(self.right_prefix, case_sensitive):
            raise ValueError(f"left and right prefix must differ: {self.left_prefix}")
        if self.change_column is not None and fold(self.change_column, case_sensitive) == fold(self.diff_column, case_sensitive):
            raise ValueError(f"change column must differ from the diff column: {self.diff_column}")

    def _with(self, **kw) -> DiffOptions:
        return dataclasses.replace(self, **kw)

    def with_diff_column(self, name: str) -> DiffOptions:
        return self._with(diff_column=name)

    def with_left_prefix(self, prefix: str) -> DiffOptions:
        return self._with(left_prefix=prefix)

    def with_right_prefix(self, prefix: str) -> DiffOptions:
        return self._with(right_prefix=prefix)

    def with_insert_value(self, value: str) -> DiffOptions:
        return self._with(insert_value=value)

    def with_change_value(self, value: str) -> DiffOptions:
        return self._with(change_value=value)

    def with_delete_value(self, value: str) -> DiffOptions:
        return self._with(delete_value=value)

    def with_nochange_value(self, value: str) -> DiffOptions:
        return self._with(nochange_value=value)

    def with_change_column(self, name: str) -> DiffOptions:
        return self._with(change_column=name)

    def without_change_column(self) -> DiffOptions:
        return self._with(change_column=None)

    def with_diff_mode(self, mode: DiffMode) -> DiffOptions:
        return self._with(mode=mode)

    def with_sparse_mode(self, sparse: bool = True) -> DiffOptions:
        return self._with(sparse=sparse)

    def with_default_comparator(self, comparator: Comparator | Callable[[Column, Column], Column]) -> DiffOptions:
        return self._with(default_comparator=as_comparator(comparator))

    def with_data_type_comparator(self, comparator: Comparator | Callable[[Column, Column], Column], *types: T.DataType) -> DiffOptions:
        """Without types, the comparator's own input type is taken."""
        comparator = as_comparator(comparator)
        if not types:
            if comparator.input_type is None:
                raise ValueError("give the data types that this comparator is for")
            types = (comparator.input_type,)
        if twice := [t.simpleString() for t in types if t in self.type_comparators]:
            raise ValueError(f"a comparator for data type {', '.join(twice)} exists already")
        for t in types:
            comparator.check_type(t, t.simpleString())
        return self._with(type_comparators={**self.type_comparators, **dict.fromkeys(types, comparator)})

    def with_column_name_comparator(self, comparator: Comparator | Callable[[Column, Column], Column], *names: str) -> DiffOptions:
        if not names:
            raise ValueError("give the column names that this comparator is for")
        if twice := [n for n in names if n in self.name_comparators]:
            raise ValueError(f"a comparator for column {', '.join(twice)} exists already")
        return self._with(name_comparators={**self.name_comparators, **dict.fromkeys(names, as_comparator(comparator))})

    def comparator_for(self, column: str, data_type: T.DataType) -> Comparator:
        """By exact name, else by exact type, else the default."""
        found = self.name_comparators.get(column) or self.type_comparators.get(data_type) or self.default_comparator
        found.check_type(data_type, column)
        return found
