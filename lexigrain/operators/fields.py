"""Fields: which columns of a table are indexed and how their tokens weigh."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lexigrain.functions.normalise import SPACE, Normaliser

#: The share that a stop word keeps of its weight.
STOP_SHARE = 0.01


@dataclass(frozen=True)
class Field:
    """A column or expression (string or array of strings) and its weight.

    weight is a number, or a function of the normalised token's column; it must be above 0.
    """

    expression: str | Column
    weight: float | Callable[[Column], Column] = 1.0

    def column(self) -> Column:
        return F.expr(self.expression) if isinstance(self.expression, str) else self.expression

    def weight_of(self, token: Column) -> Column:
        if callable(self.weight):
            return self.weight(token)
        if not self.weight > 0:
            raise ValueError("a field's weight must be above 0")
        return F.lit(float(self.weight))


def with_stop_words(weight: float, words: Sequence[str], normaliser: Normaliser, share: float = STOP_SHARE) -> Callable[[Column], Column]:
    """A weight that stop words have a share of; the words are normalised as tokens are, to constants."""

    def of(token: Column) -> Column:  # literals need a session, so they are made here and not when a module is imported
        forms = [normaliser.literal(w) for w in words]
        return F.lit(float(weight)) * F.when(token.isin(*forms), F.lit(share)).otherwise(F.lit(1.0))

    return of


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{SPACE}]")


def sections(table: DataFrame, key: str | Column, fields: Sequence[Field]) -> DataFrame:
    """key, _source (row), retriever, section, field_idx, text of each text that isn't blank.

    field_idx counts a row's texts from 0, or from 1 if the first field has none: 0 always means the first field.
    """
    if not fields:
        raise ValueError("at least one field")
    key_column = F.col(key) if isinstance(key, str) else key
    picked = table.select(key_column.alias("key"), F.monotonically_increasing_id().alias("_source"), *[f.column().alias(f"_f{i}") for i, f in enumerate(fields)])

    def parts(i: int) -> Column:
        c = F.col(f"_f{i}")
        if isinstance(picked.schema[f"_f{i}"].dataType, ArrayType):
            found = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, j: F.struct(F.lit(i).alias("retriever"), j.cast("int").alias("section"), x.cast("string").alias("text")))
        else:
            found = F.array(F.struct(F.lit(i).alias("retriever"), F.lit(0).alias("section"), c.cast("string").alias("text")))
        return F.filter(found, lambda x: ~is_blank(x["text"]))

    listed = picked.select("key", "_source", F.concat(*[parts(i) for i in range(len(fields))]).alias("_all"))
    first = F.when(F.element_at("_all", 1)["retriever"] == 0, 0).otherwise(1)
    rows = listed.where(F.size("_all") > 0).select("key", "_source", first.alias("_first"), F.posexplode("_all").alias("_pos", "_s"))
    return rows.select("key", "_source", F.col("_s.retriever").alias("retriever"), F.col("_s.section").alias("section"), (F.col("_pos") + F.col("_first")).cast("int").alias("field_idx"), F.col("_s.text").alias("text"))
