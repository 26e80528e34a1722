"""An index configuration inferred from a table's schema.

Strings, arrays of strings, structs and arrays of structs are walked; each leaf is a field named by its
dotted path. Maps and nested arrays are skipped, the latter with a warning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from lexigrain.functions.normalise import Normaliser, PluralNormaliser, stop_words
from lexigrain.logs import Logger, Null
from lexigrain.operators.fields import Field, with_stop_words
from lexigrain.operators.index import Combiner, Index, build_index
from lexigrain.operators.tokenise import Breaker, default_breaker


@dataclass(frozen=True)
class AutoIndexer:
    """Immutable settings; each with_ or other method returns changed ones."""

    key: str | None = None
    normaliser: Normaliser = field(default_factory=PluralNormaliser)
    breaker: Breaker = field(default_factory=default_breaker)
    combiner: Combiner = "sum"
    logger: Logger = Null()
    language: str = "en"
    capture_locations: bool = True
    first: str | None = None
    multipliers: tuple[tuple[str, float], ...] = ()
    token_weight: Callable[[str], Callable[[Column], Column] | float | None] | None = None

    def with_key(self, key: str) -> AutoIndexer:
        return replace(self, key=key)

    def with_normaliser(self, normaliser: Normaliser) -> AutoIndexer:
        return replace(self, normaliser=normaliser)

    def with_breaker(self, breaker: Breaker) -> AutoIndexer:
        return replace(self, breaker=breaker)

    def inject_breaker(self, wrap: Callable[[Breaker], Breaker]) -> AutoIndexer:
        """Wraps the breaker in use."""
        return replace(self, breaker=wrap(self.breaker))

    def with_combiner(self, combiner: Combiner) -> AutoIndexer:
        return replace(self, combiner=combiner)

    def with_logger(self, logger: Logger) -> AutoIndexer:
        return replace(self, logger=logger)

    def with_token_weight(self, weight: Callable[[str], Callable[[Column], Column] | float | None]) -> AutoIndexer:
        """A function from a path to its weight (None leaves it out); replaces multipliers and ignored paths."""
        return replace(self, token_weight=weight)

    def weigh(self, path: str, multiplier: float) -> AutoIndexer:
        """The weight of a path, or of what lies under it; the last setting that fits a path holds."""
        if not multiplier > 0:
            raise ValueError("a multiplier must be above 0")
        return replace(self, multipliers=(*self.multipliers, (path, float(multiplier))))

    def ignore(self, path: str) -> AutoIndexer:
        """Leaves a path out, with all that lies under it."""
        return replace(self, multipliers=(*self.multipliers, (path, 0.0)))

    def first_field(self, path: str) -> AutoIndexer:
        """Makes a path the first field, which field_idx 0 stands for."""
        return replace(self, first=path)

    def without_locations(self) -> AutoIndexer:
        return replace(self, capture_locations=False)

    def _multiplier(self, path: str) -> float:
        """The last setting for the path or, by its name alone, for its last part; 0 if a part above is ignored."""
        parts = path.split(".")
        out = 1.0
        for at, m in self.multipliers:
            if path == at or parts[-1] == at or path.endswith(f".{at}"):
                out = m
        above = [".".join(parts[:n]) for n in range(1, len(parts))]
        for up in above:
            last = None
            for at, m in self.multipliers:
                if up == at or up.split(".")[-1] == at:
                    last = m
            if last == 0:
                return 0.0
        return out

    def paths(self, schema: StructType) -> list[tuple[str, Column]]:
        """(path, expression) of each field that is indexed, the first one in front."""
        found: list[tuple[str, Column]] = []

        def walk(kind: DataType, path: str, c: Column, deep: int) -> None:
            if isinstance(kind, StringType):
                flat = c
                for _ in range(deep - 1):
                    flat = F.flatten(flat)
                found.append((path, flat))
            elif isinstance(kind, StructType):
                for f in kind.fields:
                    inner = _deeper(c, f.name, deep) if deep else c[f.name]
                    walk(f.dataType, f"{path}.{f.name}", inner, deep)
            elif isinstance(kind, ArrayType):
                if isinstance(kind.elementType, ArrayType):
                    self.logger.warning(f"{path}: nested arrays aren't indexed")
                else:
                    walk(kind.elementType, path, c, deep + 1)

        for f in schema.fields:
            walk(f.dataType, f.name, F.col(f"`{f.name}`"), 0)
        if self.first is not None:
            if self.first not in [p for p, _ in found]:
                raise ValueError(f"no field {self.first!r}")
            found.sort(key=lambda x: x[0] != self.first)
        return found

    def fields(self, schema: StructType) -> list[Field]:
        out = []
        words = stop_words(self.language)
        for path, c in self.paths(schema):
            weight = self.token_weight(path) if self.token_weight is not None else self._multiplier(path)
            if weight is None or weight == 0 and not callable(weight):
                continue
            if not callable(weight):
                weight = with_stop_words(weight, words, self.normaliser) if words else float(weight)
            out.append(Field(c, weight))
        return out

    def key_of(self, columns: Sequence[str]) -> str:
        """The key: as set, else a column called key, else one called id."""
        if self.key is not None:
            return self.key
        lower = {c.lower(): c for c in reversed(columns)}
        for name in ("key", "id"):
            if name in lower:
                return lower[name]
        raise ValueError("no column is called key or id: name the key")

    def build(self, table: DataFrame) -> Index:
        fields = self.fields(table.schema)
        if not fields:
            raise ValueError("no field to index")
        return build_index(table, self.key_of(table.columns), fields, self.normaliser, self.breaker, self.combiner, self.capture_locations, self.logger)


def _deeper(c: Column, name: str, deep: int) -> Column:
    return F.transform(c, lambda x: x[name]) if deep == 1 else F.transform(c, lambda x: _deeper(x, name, deep - 1))
