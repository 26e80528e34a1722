"""The weighted inverted index: a DataFrame of (token, key, weight, locations), its making and its algebra.

Entries are grouped by token and key, so a frequent token is as many small groups as documents
hold it; texts are shuffled by key before they are cut into tokens. Saved indexes are sorted by token, and a
look-up is a pushed-down equality.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.normalise import Normaliser, PluralNormaliser
from lexigrain.logs import Logger, Null

from . import fields as fields_
from .tokenise import Breaker, default_breaker

LOCATIONS = "array<struct<field_idx:int,token_idx:int,src_idx:int,src_len:int,contrib:double>>"

#: A combiner of weights: a name, or a function from an array column to a column.
Combiner = str | Callable[[Column], Column]


def combined(weight: Column, how: Combiner) -> Column:
    """The aggregate of a combiner: sum, max, min, avg, or a function of the (sorted) array of weights."""
    if callable(how):
        return how(F.sort_array(F.collect_list(weight)))
    return {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[how](weight)


def positive(weight: Column) -> Column:
    return F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("a combined weight must be above 0")).cast("double"))


def joined_locations(locations: Column) -> Column:
    """Locations of all rows, sorted; null if any row has none recorded."""
    return F.when(F.count_if(locations.isNull()) > 0, F.lit(None).cast(LOCATIONS)).otherwise(F.sort_array(F.flatten(F.collect_list(locations))))


@dataclass(frozen=True)
class Index:
    """Entries and how their tokens were made. Operations return new indexes."""

    entries: DataFrame
    normaliser: Normaliser = field(default_factory=PluralNormaliser)
    breaker: Breaker = field(default_factory=default_breaker)

    def validated(self) -> Index:
        """Checks entries (one job): no null key, empty token, weight of 0 or less, or empty list of locations."""
        bad = self.entries.where("key IS NULL OR token IS NULL OR token = '' OR weight IS NULL OR weight <= 0 OR size(locations) = 0")
        if bad.limit(1).count():
            raise ValueError("invalid entries")
        return self

    def form(self, token: str) -> Column:
        return self.normaliser.literal(token)

    def lookup(self, token: str) -> DataFrame:
        """key, weight, locations of a token."""
        if not token.strip():
            raise ValueError("blank token")
        return self.entries.where(F.col("token") == self.form(token)).where(F.col("token") != "").select("key", "weight", "locations")

    def combine(self, others: Sequence[Index], how: Combiner = "sum") -> Index:
        """Union with equal (token, key) combined. Associative combiners take one grouping; others fold in order, and see
        only what more than one index holds."""
        if how in ("sum", "max", "min"):
            rows = self.entries
            for other in others:
                rows = rows.unionByName(other.entries)
            return replace(self, entries=_grouped(rows, how))
        rows = self.entries
        for other in others:
            rows = _grouped(rows.unionByName(other.entries), how)
        return replace(self, entries=rows)

    def add(self, entries: DataFrame) -> Index:
        """Appends entries as they are: a (token, key) may then occur twice."""
        return replace(self, entries=self.entries.unionByName(entries.select("token", "key", "weight", "locations")))

    def remove_where(self, condition: str | Column) -> Index:
        """Without the entries whose key meets the condition."""
        c = F.expr(condition) if isinstance(condition, str) else condition
        return replace(self, entries=self.entries.where(~F.coalesce(c, F.lit(False))))

    def remove_keys(self, keys: DataFrame) -> Index:
        """Without the entries of the given keys (column key). Spark broadcasts them only if they are small."""
        return replace(self, entries=self.entries.join(keys.select("key").distinct(), "key", "left_anti").select("token", "key", "weight", "locations"))

    def vocabulary(self) -> DataFrame:
        return self.entries.select("token").distinct()

    def locations_available(self) -> DataFrame:
        """One row: whether every entry has locations (true for an empty index)."""
        return self.entries.agg(F.coalesce(F.bool_and(F.col("locations").isNotNull()), F.lit(True)).alias("available"))

    def to_dictionary(self) -> DataFrame:
        """token and its sorted list of (key, weight)."""
        return self.entries.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("postings"))

    def occurrences(self) -> DataFrame:
        """One row per location: token, key and the location's fields."""
        return self.entries.select("token", "key", F.inline("locations"))


def _grouped(rows: DataFrame, how: Combiner) -> DataFrame:
    several = F.count(F.lit(1)) > 1
    weight = F.when(several, combined(F.col("weight"), how)).otherwise(F.max("weight"))
    return rows.groupBy("token", "key").agg(positive(weight).alias("weight"), joined_locations(F.col("locations")).alias("locations")).select("token", "key", "weight", "locations")


def occurrences(table: DataFrame, key: str | Column, fields: Sequence[fields_.Field], normaliser: Normaliser, breaker: Breaker, positions: bool = True) -> DataFrame:
    """token, key, field_idx, token_idx, src_idx, src_len, contrib of every token that is valid."""
    return _occurrences(fields_.sections(table, key, fields), fields, normaliser, breaker, positions)


def _occurrences(texts: DataFrame, fields: Sequence[fields_.Field], normaliser: Normaliser, breaker: Breaker, positions: bool) -> DataFrame:
    tokens = breaker.break_text(texts, positions)
    # Catalyst would push the filter below the normaliser's projections, each of which repeats the one before; a projection that isn't deterministic stops it
    formed = normaliser.add(tokens, "token", "token").withColumn("_here", F.monotonically_increasing_id()).where("token <> '' AND _here >= 0")
    weight = fields[0].weight_of(F.col("token"))
    if len(fields) > 1:
        weight = F.when(F.col("retriever") == 0, weight)
        for i, f in enumerate(fields[1:], 1):
            weight = weight.when(F.col("retriever") == i, f.weight_of(F.col("token")))
    return formed.select("token", "key", "field_idx", "token_idx", "src_idx", "src_len", (weight * F.col("multiplier")).alias("contrib"))


def build_index(table: DataFrame, key: str | Column, fields: Sequence[fields_.Field], normaliser: Normaliser | None = None, breaker: Breaker | None = None, combiner: Combiner = "sum", capture_locations: bool = True, logger: Logger = Null()) -> Index:  # noqa: B008
    """Indexes the fields of a table. Rows of equal key become one document. Texts are shuffled by key; their tokens are then grouped where they are."""
    normaliser, breaker = normaliser or PluralNormaliser(), breaker or default_breaker()
    logger.debug(f"indexing {len(fields)} fields")
    texts = fields_.sections(table, key, fields).repartition("key")
    found = _occurrences(texts, fields, normaliser, breaker, capture_locations)
    place = F.struct("field_idx", "token_idx", "src_idx", "src_len", "contrib")
    locations = F.sort_array(F.collect_list(place)) if capture_locations else F.lit(None).cast(LOCATIONS)
    entries = found.groupBy("token", "key").agg(positive(combined(F.col("contrib"), combiner)).alias("weight"), *([locations.alias("locations")] if capture_locations else []))
    if not capture_locations:
        entries = entries.withColumn("locations", locations)
    return Index(entries, normaliser, breaker)


# Tables of token and value, as dictionaries


def put(table: DataFrame, additions: DataFrame, normaliser: Normaliser, how: str = "last") -> DataFrame:
    """Adds (token, value) pairs; tokens are normalised and must not become empty. An equal token takes the later value
    (additions in order of their column seq), or the sum, max or min."""
    old = table.select("token", "value", F.lit(-1).cast("long").alias("seq"))
    form = F.col("token")
    checked = F.when(form != "", form).otherwise(F.raise_error(F.lit("a token must not be blank")))
    new = normaliser.add(additions, "token", "token").select(checked.alias("token"), "value", F.col("seq").cast("long").alias("seq"))
    value = F.max_by("value", "seq") if how == "last" else combined(F.col("value"), how)
    return old.unionByName(new).groupBy("token").agg(value.alias("value")).where(F.col("value").isNotNull())


def get(table: DataFrame, token: str, normaliser: Normaliser) -> DataFrame:
    return table.where(F.col("token") == normaliser.literal(token))


def get_or_fail(table: DataFrame, token: str, normaliser: Normaliser) -> object:
    row = get(table, token, normaliser).first()
    if row is None:
        raise KeyError(token)
    return row["value"]


def remove_tokens(table: DataFrame, tokens: DataFrame, normaliser: Normaliser) -> DataFrame:
    return table.join(normaliser.add(tokens.select("token"), "token", "token").distinct(), "token", "left_anti").select(table.columns)


def map_values(table: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Values changed; null removes the token."""
    return table.withColumn("value", change(F.col("value"))).where(F.col("value").isNotNull())
