"""Pandas frames for Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with these columns computed before anything asks for them.

    A filter on a computed column is pushed below it, and what the column is made of is evaluated there and once more
    above. No filter passes a generator that makes its columns.
    """
    made = F.explode_outer(F.array(F.struct(*columns))).alias("_made")
    return df.select(*[c for c in df.columns if c not in columns], made).select(*[F.col(f"_made.{c}") if c in columns else F.col(c) for c in df.columns])


def frame(**columns: Iterable) -> pd.DataFrame:
    """A frame of plain Python objects, which Arrow converts by the UDF's schema alone."""
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})


def frame_of(rows: Sequence[tuple], names: Sequence[str]) -> pd.DataFrame:
    """The same from row tuples."""
    return frame(**dict(zip(names, zip(*rows) if rows else [[] for _ in names])))
