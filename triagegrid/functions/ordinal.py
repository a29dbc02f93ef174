"""Urgency is ordered: compare ranks, decode at the end."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid.lexicon import URGENCIES

RANK = {name: rank for rank, name in enumerate(URGENCIES)}


def urgency_rank(urgency: Column) -> Column:
    """0..3, or null for a value that is not an urgency."""
    return F.coalesce(
        *[F.when(urgency == F.lit(name), F.lit(rank)) for name, rank in RANK.items()]
    )


def urgency_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(u) for u in URGENCIES]), rank)


def max_urgency(a: Column, b: Column) -> Column:
    return urgency_name(F.greatest(urgency_rank(a), urgency_rank(b)))
