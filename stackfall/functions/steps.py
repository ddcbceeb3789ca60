"""Expressions built in named steps, each evaluated once per row.

A nested Column repeats a sub-expression wherever it is used, which outgrows generated code.
``Steps`` states the steps once and offers both forms a caller needs: a chain of projections
for a whole frame (stays in generated code) and a single Column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Values:
    """Attribute access to the steps computed so far."""

    def __init__(self, values: dict[str, Column]):
        self._values = values

    def __getattr__(self, name: str) -> Column:
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(name) from None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus a column the optimizer computes exactly once.

    The one-element ``explode`` keeps it from copying the expression into filters and later
    projections; it neither adds nor drops a row and stays in generated code.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def _session_key() -> int:
    """Column objects belong to one JVM gateway."""
    return id(SparkContext._gateway)


class Steps:
    """``Steps(a=lambda v: …, b=lambda v: … v.a …)``; the input is ``v.line``.

    Expressions over a frame are built once per column name and kept: they are hundreds of
    driver calls, and the same for every query.
    """

    def __init__(self, **steps: Callable[[Values], Column]):
        self._steps = list(steps.items())
        self._built: dict[tuple, object] = {}

    def column(self, line: Column) -> Column:
        """The last step as one Column."""

        def go(at: int, values: dict[str, Column]) -> Column:
            name, build = self._steps[at]
            value = build(Values(values))
            if at == len(self._steps) - 1:
                return value
            return let(value, lambda bound: go(at + 1, {**values, name: bound}))

        return let(line, lambda bound: go(0, {"line": bound}))

    def on(self, df: DataFrame, line: Column, name: str) -> DataFrame:
        """``df`` plus the last step as (pinned) column ``name``: a chain of projections, all in
        generated code."""
        kept = df.columns
        prefix = f"_{name}_"
        key = (_session_key(), name)
        if key not in self._built:
            values = {"line": F.col(f"{prefix}line")}
            chain = []
            for step, build in self._steps:
                chain.append((prefix + step, build(Values(values))))
                values[step] = F.col(prefix + step)
            self._built[key] = chain
        out = df.withColumn(f"{prefix}line", line)
        chain = self._built[key]
        for column, value in chain:
            out = out.withColumn(column, value)
        return pinned(out.select(*kept, F.col(chain[-1][0]).alias(name)), name, F.col(name))
