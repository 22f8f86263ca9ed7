"""Multi-version visibility as a predicate over version columns: inserting, deleting transaction and deleted flag."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReadView:
    """What a transaction sees: `me`, the first id not yet given out (`limit`), and ids active at its start."""

    me: int
    limit: int
    active: Collection[int] = field(default_factory=frozenset)


def committed(txn: Column, view: ReadView) -> Column:
    """The transaction had ended when the view was taken. Id 0 stands for rows loaded outside transactions."""
    return (txn == 0) | ((txn < view.limit) & ~txn.isin(*view.active)) if view.active else (txn == 0) | (txn < view.limit)


def visible(view: ReadView, inserted: str = "_ins_txn", deleted_by: str = "_del_txn", deleted: str = "_deleted") -> Column:
    """Own inserts and committed ones, unless deleted by oneself or by a committed transaction."""
    ins, dele, gone = F.col(inserted), F.col(deleted_by), F.coalesce(F.col(deleted), F.lit(False))
    here = (ins == view.me) | committed(ins, view)
    away = gone & ((dele == view.me) | committed(dele, view))
    return here & ~F.coalesce(away, F.lit(False))
