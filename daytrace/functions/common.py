"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys, as they do in groups and windows; one copy of the key columns stays."""
    if not on:
        return left.join(right, [], how)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    out = left.join(right, same, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_r_{k}" for k in on])
