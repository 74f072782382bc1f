"""Growth between two amounts, and the classes derived from it.

The three forms differ only in what a missing or zero base means, which is
why each has its own name. None of them divides by zero: ANSI mode would fail
the query, and an infinite or undefined ratio must not reach the statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _ratio(new: Column, old: Column) -> Column:
    return (new - old) / old


def trend_growth(second: Column, first: Column) -> Column:
    """Half over half. No second half: 0. Zero first half: size of the second."""
    return (
        F.when(second.isNull() | first.isNull(), 0.0)
        .when(first == 0, F.abs(second))
        .otherwise(_ratio(second, first))
    )


def actual_growth(test: Column, train: Column) -> Column:
    """Observed change. No training total: the test total. Zero: size of the test total."""
    return (
        F.when(train.isNull(), test)
        .when(train == 0, F.abs(test))
        .otherwise(_ratio(test, train))
    )


def predicted_growth(predicted: Column, train: Column) -> Column:
    """Predicted change. No or zero training total: the prediction with its own sign."""
    base = F.coalesce(train, F.lit(0.0))
    return F.when(base == 0, predicted).otherwise(_ratio(predicted, base))


def sign_class(value: Column) -> Column:
    """1 growing, -1 shrinking, 0 flat or unknown."""
    return F.coalesce(F.signum(value), F.lit(0.0)).cast("int")


def change_class(test: Column, train: Column, change: Column) -> Column:
    """2 new, -1 down, 0 unchanged, 1 up; NULL when none applies. First match wins."""
    return (
        F.when((test > 0) & (train == 0), 2)
        .when(change < 0, -1)
        .when(change == 0, 0)
        .when((change > 0) & (train != 0), 1)
    )


def carry_trend(first: Column, second: Column) -> Column:
    """Next period's total if the step between the two halves goes on, never below zero.

    The next two halves continue the line through ``first`` and ``second``:
    (2b - a) + (3b - 2a) = 5b - 3a.
    """
    a = F.coalesce(first, F.lit(0.0))
    b = F.coalesce(second, F.lit(0.0))
    return F.greatest(5 * b - 3 * a, F.lit(0.0))
