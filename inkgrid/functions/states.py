"""Identity states, their order, and how states, reasons and confidences of members combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identity states from best to worst.
STATES = ("CONFIRMED", "HIGH_CONFIDENCE", "AMBIGUOUS", "INSUFFICIENT", "UNRESOLVED")


def rank(state: Column) -> Column:
    """Place in STATES; unknown names rank last."""
    place = F.array_position(F.array(*map(F.lit, STATES)), state)
    return F.when(place > 0, place).otherwise(len(STATES))


def named(place: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATES)), (place - 1).cast("int"))


def worst(state: Column) -> Column:
    """Aggregate: the worst state of a group."""
    return named(F.max(rank(state)))


def worst_of(*states: Column) -> Column:
    return named(F.greatest(*map(rank, states)))


def reasons(column: Column) -> Column:
    """Aggregate: the sorted union of arrays of reasons."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def overall(*parts: Column) -> Column:
    """The least confidence that is present; 0 if none is."""
    return F.coalesce(F.least(*parts) if len(parts) > 1 else parts[0], F.lit(0.0))


def strict_sum(column: Column) -> Column:
    """Aggregate: null as soon as one member is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))
