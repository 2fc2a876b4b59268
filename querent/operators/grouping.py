"""Grouping elements: plain keys, ROLLUP, CUBE and nested GROUPING SETS.

An element is a list of key sets. ROLLUP gives its prefixes, CUBE its subsets,
one grouping set is the cross product of its elements, and several elements of
one query multiply as well. Duplicated sets stay, as in SQL.
"""

from __future__ import annotations

from itertools import combinations, product

from querent.functions.expr import AGGREGATED, Key, Record
from querent.functions.shape import Opt

KeySets = list[list[Key]]


class Unit:
    """One key of one or more columns; ``record`` is how the result shows it (nullable)."""

    def __init__(self, source: Record):
        self.keys = [Key(e) for e in source.columns()]
        self.record = Record(Opt(source._shape), list(self.keys), AGGREGATED)
        self.sets: KeySets = [self.keys]


class Power:
    def __init__(self, sets: KeySets):
        self.sets = sets


Element = Unit | Power


def key(source: Record) -> Unit:
    return Unit(source)


bkey = key


def rollup(*units: Unit) -> Power:
    return Power([[k for u in units[:n] for k in u.keys] for n in range(len(units), -1, -1)])


def cube(*units: Unit) -> Power:
    return Power([[k for u in own for k in u.keys] for n in range(len(units), -1, -1) for own in combinations(units, n)])


def cross(elements: list[Element]) -> KeySets:
    return [[k for part in parts for k in part] for parts in product(*[e.sets for e in elements])]


def key_set(*elements: Element) -> Power:
    """One parenthesised grouping set; nested rollups and cubes multiply out."""
    return Power(cross(list(elements)))


def grouping_sets(*sets: Element) -> Power:
    return Power([s for e in sets for s in e.sets])
