"""A filter tree as a Spark column, or as a Python predicate for tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.filterlang.lexemes import FilterError
from tidemark.filterlang.tree import Every, Name, Signed, Test, parse

EQUAL = ("=", ":")


@dataclass(frozen=True)
class Mode:
    """``compat`` takes every comparator for equality, as the language's first implementation did."""

    compat: bool = False


@dataclass(frozen=True)
class _Leaf:
    """What one test asks: a tag (``key`` None) or the value of an annotation; ``differs`` for ``!=``."""

    key: str | None
    value: str
    differs: bool


def _leaf(test: Test, mode: Mode) -> _Leaf:
    field, *below = test.name.words
    if field.text not in ("tags", "annotations"):
        raise FilterError(f"unknown field {field.text!r}")
    if not isinstance(test.argument, Name) or (field.text == "annotations" and not below):
        raise FilterError(f"{field.text} needs " + ("a key and a value" if field.text == "annotations" else "a value"))
    value = test.argument.words[0]
    if not value.quoted:
        raise FilterError(f"the value of {field.text} must be quoted")
    if not mode.compat and test.comparator not in (*EQUAL, "!="):
        raise FilterError(f"{field.text} has no order: {test.comparator}")
    key = below[0].text if field.text == "annotations" else None
    return _Leaf(key, value.text, test.comparator == "!=" and not mode.compat)


def _fold(node: Every | Signed | Test, leaf: Callable[[_Leaf], Any], both, either, opposite, mode: Mode):
    again = lambda n: _fold(n, leaf, both, either, opposite, mode)
    match node:
        case Every(runs):
            return reduce(both, [reduce(either, map(again, c.options)) for run in runs for c in run])
        case Signed(negated, body):
            return opposite(again(body)) if negated else again(body)
        case Test():
            asked = _leaf(node, mode)
            return opposite(leaf(asked)) if asked.differs else leaf(asked)
    raise TypeError(node)


def compile_filter(text: str, tags: str = "tags", annotations: str = "annotations", mode: Mode = Mode()) -> Column:
    """A BOOLEAN column that is never null.

    A null array or map, a null element and a missing key hold nothing, so a
    test of them is false and its negation true. All errors are raised here,
    before any data is read.
    """
    tree = parse(text)
    if tree is None:
        return F.lit(True)

    def column(leaf: _Leaf) -> Column:
        if leaf.key is None:
            hit = F.array_contains(F.col(tags), leaf.value)
        else:
            hit = F.col(annotations).getItem(leaf.key) == F.lit(leaf.value)
        return F.coalesce(hit, F.lit(False))

    return _fold(tree, column, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a, mode)


def evaluate(text: str, tags: Sequence[str | None] | None, annotations: Mapping[str, str | None] | None, mode: Mode = Mode()) -> bool:
    """The same filter on one row in plain Python."""
    tree = parse(text)
    if tree is None:
        return True

    def holds(leaf: _Leaf) -> bool:
        return leaf.value in (tags or ()) if leaf.key is None else (annotations or {}).get(leaf.key) == leaf.value

    return _fold(tree, holds, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a, mode)
