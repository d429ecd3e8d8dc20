"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body(value)``.

    A one-element ``transform`` keeps the bound value a lambda variable, so
    Catalyst cannot inline (and duplicate) it into every use or into a
    pushed-down filter; the expression tree and generated code stay small.
    """
    return F.get(F.transform(F.array(value), body), 0)


def any_contains(c: Column, needles: list[str]) -> Column:
    cond = c.contains(needles[0])
    for n in needles[1:]:
        cond = cond | c.contains(n)
    return cond
