"""Number reservation: a one-row table holds the last number issued."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from querent.sources.store import Conflict, Store


class Sequence:
    """``column`` of the one-row table of ``model``."""

    def __init__(self, store: Store, model: type, column: str):
        self.store, self.model, self.column = store, model, column
        field = next(f for f in model.__fields__ if f.name == column)
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(field.dtype), 63)
        self.most = (1 << bits) - 1

    def update_number(self, number: int) -> int:
        """SET n = number WHERE n <= number: numbers never go back."""

        def describe(a: Any, row: Any) -> None:
            a.assign(self.column, number)
            a.wheres(row[self.column] <= number)

        return self.store.update(self.model, describe)

    def get_pool(self, size: int, tries: int = 20) -> list[int]:
        """The next ``size`` numbers, reserved in a transaction of their own."""
        if size < 1:
            raise ValueError("a pool has at least one number")
        for _ in range(tries):
            try:
                with self.store.transaction() as tx:
                    rows = tx.read(self.model.__table__).select(self.column).take(2)
                    if len(rows) != 1:
                        raise ValueError(f"a sequence table has one row, not {'none' if not rows else 'more'}")
                    last = rows[0][0]
                    if last + size > self.most:
                        raise OverflowError("the sequence has run out of numbers")
                    tx.update(self.model, lambda a, row, n=last + size: a.assign(self.column, n).wheres(row[self.column] <= n))
                return list(range(last + 1, last + size + 1))
            except Conflict:
                continue
        raise Conflict("other writers kept getting in first")

    def get_auto_pool(self, size: int) -> Iterator[int]:
        """Numbers without end, reserved ``size`` at a time as they are used."""
        while True:
            yield from self.get_pool(size)
