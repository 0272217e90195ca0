"""Expressions that are evaluated once however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once.

    The optimiser inlines projected columns into each of their uses; a lambda variable stays one node, which
    keeps deep expressions from growing exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
