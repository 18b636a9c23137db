"""Columns that are made once.

A Column belongs to no DataFrame: it is an expression over names, which Spark
resolves wherever it is used. Making one crosses into the JVM for every operator
in it, some milliseconds each time, so the large ones (rules, correlations,
lifecycle tables) are made once per driver process and used for every plan.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def made_once(make: Callable, of: Callable = lambda *args: args) -> Callable:
    """Remembers what a function of plain values returns; `of` turns its arguments into such values where they are not.

    Calls whose arguments cannot be compared by value (Columns) are made anew.
    """
    kept: dict = {}

    @functools.wraps(make)
    def once(*args):
        # Expressions live in one JVM; a new one starts from nothing.
        try:
            key = (id(SparkContext._gateway), of(*args))
            if key not in kept:
                kept[key] = make(*args)
            return kept[key]
        except TypeError as e:
            if "unhashable" not in str(e):
                raise
            return make(*args)

    return once
