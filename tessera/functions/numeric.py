"""Exact money: decimal inputs, double outputs, averages as sum over count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: str | Column) -> Column:
    """A money, rate or quantity column as decimal(15, 2), so that sums do not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(15,2)")


def exact_sum(column: str | Column) -> Column:
    return F.sum(money(column)).cast("double")


def exact_avg(column: str | Column) -> Column:
    return exact_sum(column) / F.count(column)


def ratio(above: Column, below: Column) -> Column:
    """above / below, null where below is 0."""
    return above / F.nullif(below, F.lit(0).cast("double"))
