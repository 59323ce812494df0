"""Conditional steps in a fluent chain."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

A, B = TypeVar("A"), TypeVar("B")


def transform_if(condition: bool, function: Callable[[A], B], otherwise: Callable[[A], B] | None = None) -> Callable[[A], A | B]:
    """For ``df.transform(transform_if(flag, f))``: f if the flag holds, else the other step or none."""
    return function if condition else otherwise or (lambda x: x)


class On:
    """``On(x, flag).call(f)`` or ``On(x, flag).either(f).otherwise(g)``."""

    def __init__(self, value, condition: bool) -> None:
        self.value, self.condition = value, condition

    def call(self, function: Callable):
        return function(self.value) if self.condition else self.value

    def either(self, function: Callable) -> _Either:
        return _Either(self, function)


class _Either:
    def __init__(self, on: On, function: Callable) -> None:
        self._on, self._function = on, function

    def otherwise(self, function: Callable):
        return (self._function if self._on.condition else function)(self._on.value)


def call(value: A, function: Callable[[A], B]) -> B:
    return function(value)
