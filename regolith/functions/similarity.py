"""Similarity of names by longest common subsequence, as native expressions.

The bit-parallel recurrence keeps one machine word of state per comparison, so strings of up to 62 characters are compared
inside the JVM; longer ones pass through an Arrow function with the same recurrence over big integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 62


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        hit = state & masks.get(y, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs_long(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="object")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of strings of which the shorter has up to 62 characters, natively."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    letters = F.split(short, "")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(short)) - F.lit(1)

    def mask(y: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))),
            F.lit(0).cast("long"),
            lambda m, i: F.when(F.element_at(letters, i) == y, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))).otherwise(m),
        )

    def step(s: Column, y: Column) -> Column:
        hit = s.bitwiseAND(mask(y))
        return (s + hit).bitwiseOR(s - hit).bitwiseAND(full)

    state = F.aggregate(F.filter(F.split(long, ""), lambda y: y != ""), full, step)
    return F.when(F.length(short) == 0, F.lit(0)).otherwise(F.length(short) - F.bit_count(state.bitwiseAND(full)))


def _ratio(distance: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) * distance / total)


def indel(a: Column, b: Column, native: bool = True) -> Column:
    """Insertions and deletions that turn one string into the other."""
    common = lcs_length(a, b) if native else _lcs_long(a, b)
    return F.length(a) + F.length(b) - F.lit(2) * common


def token_set_ratio(left: Column, right: Column, native: bool = False) -> Column:
    """Likeness (0 to 100) of two token arrays as sets: shared tokens count once, the best of three comparisons holds."""
    both = F.array_sort(F.array_intersect(left, right))
    a, b = F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
    si, sa, sb = F.array_join(both, " "), F.array_join(a, " "), F.array_join(b, " ")
    li, la, lb = F.length(si), F.length(sa), F.length(sb)
    gap = F.when(li > 0, F.lit(1)).otherwise(F.lit(0))
    ia, ib = li + F.when(la > 0, gap).otherwise(F.lit(0)) + la, li + F.when(lb > 0, gap).otherwise(F.lit(0)) + lb
    rest = _ratio(indel(sa, sb, native), ia + ib)
    shared = F.greatest(rest, _ratio(la + 1, li + ia), _ratio(lb + 1, li + ib))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).when((li > 0) & ((la == 0) | (lb == 0)), F.lit(100.0)).when(li > 0, shared).otherwise(rest)


def token_sort_ratio(left: Column, right: Column, native: bool = False) -> Column:
    """Likeness (0 to 100) of two texts with their words sorted."""
    order = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")), " ")
    a, b = order(left), order(right)
    return F.when((left == "") | (right == ""), F.lit(0.0)).otherwise(_ratio(indel(a, b, native), F.length(a) + F.length(b)))
