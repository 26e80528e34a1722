"""From a parsed query to one lazy DataFrame of results.

The parse is done on the driver; what it yields is a plan of look-ups, semi-joins, anti-joins and
groupings that Catalyst optimises as a whole. Equal leaves are built once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.index import Combiner, Index, combined, joined_locations, positive
from lexigrain.operators.search import phrase_match
from lexigrain.operators.tokenise import Breaker

from .parser import Combining, Compulsory, Excluding, NoMatch, Precise, Segment, Standard, parse

#: Combines the weights of a key at one level of a query: a name, or a function of the weights' array and the number of segments.
MatchCombiner = Combiner | Callable[[Column, int], Column]


@dataclass
class Querier:
    """Answers query strings: terms from the standard index, phrases from the precise one (which needs locations)."""

    standard: Index
    precise: Index | None = None
    breaker: Breaker | None = None
    combiner: MatchCombiner = "sum"
    _known: dict[Segment, DataFrame] = field(default_factory=dict, repr=False)

    def matches(self, query: str) -> DataFrame:
        if not query.strip():
            raise ValueError("blank query")
        return self.evaluate(parse(query))

    def evaluate(self, segment: Segment) -> DataFrame:
        return self._level(segment.segments if isinstance(segment, Combining) else (segment,))

    def _leaf(self, segment: Segment) -> DataFrame:
        if segment not in self._known:
            if isinstance(segment, Precise):
                index = self.precise or self.standard
                self._known[segment] = phrase_match(index, segment.value, self.breaker or index.breaker)
            else:
                self._known[segment] = self.standard.lookup(segment.value)
        return self._known[segment]

    def _level(self, segments: tuple[Segment, ...]) -> DataFrame:
        pool: list[DataFrame] = []
        needed: list[DataFrame] = []
        barred: list[DataFrame] = []
        for s in segments:
            if isinstance(s, NoMatch):
                continue
            if isinstance(s, Combining):
                pool.append(self._level(s.segments))
            elif isinstance(s, Compulsory):
                found = self.evaluate(s.segment)
                needed.append(found.select("key"))
                pool.append(found)
            elif isinstance(s, Excluding):
                barred.append(self.evaluate(s.segment).select("key"))
            elif isinstance(s, (Standard, Precise)):
                pool.append(self._leaf(s))
            else:
                raise TypeError(f"unknown segment {s!r}")
        rows = pool[0] if pool else self.standard.entries.select("key", "weight", "locations").limit(0)
        for r in pool[1:]:
            rows = rows.unionByName(r)
        for keys in needed:
            rows = rows.join(keys, "key", "left_semi")
        for keys in barred:
            rows = rows.join(keys, "key", "left_anti")
        how = self.combiner
        if callable(how):
            weight = how(F.sort_array(F.collect_list("weight")), len(segments))
        else:
            weight = combined(F.col("weight"), how)
        return rows.groupBy("key").agg(positive(weight.cast("double")).alias("weight"), joined_locations(F.col("locations")).alias("locations"))
