"""Naming an intermediate value inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is evaluated once per row however often `body` uses it.

    A plain Column used several times is repeated in the plan each time. That is free for
    a column reference and costly for a parsed document.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
