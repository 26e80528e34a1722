"""Searches over an index; results are (key, weight, locations).

A query's tokens are found on the driver (a query is short) and become literal conditions, which
reach the Parquet scan. Groupings combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import LOCATIONS, Combiner, Index, combined, joined_locations, positive
from .tokenise import Breaker


def query_terms(spark: SparkSession, query: str, breaker: Breaker, index: Index) -> list[tuple[str, float, str]]:
    """(form, multiplier, token) of each token of a query, in order."""
    texts = spark.createDataFrame([(0, query)], "_row int, text string").coalesce(1)
    rows = index.normaliser.add(breaker.break_text(texts), "token", "form").select("token_idx", "src_idx", "src_len", "token", "multiplier", "form").collect()
    rows.sort(key=lambda r: (r["src_len"] if len({x["token_idx"] for x in rows}) < len(rows) else 0, r["token_idx"], r["token"]))
    return [(r["form"], r["multiplier"], r["token"]) for r in rows]


def empty_results(index: Index) -> DataFrame:
    return index.entries.select("key", "weight", "locations").limit(0)


def partial_match(index: Index, query: str, breaker: Breaker | None = None, mode: str | int = "all", how: Combiner = "sum", combiner: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """Keys that hold the query's tokens: all of them, any, or at least so many (mode); weights combined by how.

    A token that is repeated in the query counts as often. combiner, if given, decides instead: it
    gets the array of (term, weight) of a key and the number of terms, and gives the weight; 0 drops the key, less is an error.
    """
    if not query:
        raise ValueError("empty query")
    spark = index.entries.sparkSession
    terms = query_terms(spark, query, breaker or index.breaker, index)
    if not terms:
        return empty_results(index)
    forms: dict[str, list[int]] = {}
    for i, (form, _, _) in enumerate(terms):
        forms.setdefault(form, []).append(i)
    found = index.entries.where(F.col("token").isin(*[f for f in forms if f])) if any(forms) else index.entries.limit(0)
    places = F.create_map(*[x for f, at in forms.items() for x in (F.lit(f), F.array(*map(F.lit, at)))])
    rows = found.withColumn("term", F.explode(F.element_at(places, F.col("token"))))
    groups = rows.groupBy("key")
    locations = joined_locations(F.col("locations")).alias("locations")
    if combiner is not None:
        weight = combiner(F.sort_array(F.collect_list(F.struct("term", "weight"))), len(terms))
        checked = F.when(weight < 0, F.raise_error(F.lit("a combined weight must not be negative")).cast("double")).otherwise(weight)
        return groups.agg(checked.cast("double").alias("weight"), locations).where("weight > 0")
    least = len(terms) if mode == "all" else 1 if mode == "any" else int(mode)
    out = groups.agg(combined(F.col("weight"), how).alias("weight"), locations, F.count_distinct("term").alias("_n"))
    return out.where(F.col("_n") >= least).select("key", "weight", "locations")


def phrase_match(index: Index, phrase: str, breaker: Breaker | None = None, run: Callable[[Column, int], Column] | None = None, final: Combiner = "sum") -> DataFrame:
    """Keys in which the phrase's tokens follow each other in one field.

    Each occurrence of the first token for which the k-th token stands k places further is a run; its
    weight is run(sum of weights, n), by default the sum times 2^(n-1), and the runs of a key are combined
    by final. An entry with one location weighs its weight, with several each its contribution. A phrase of
    one token is a plain look-up of the phrase as it is.
    """
    if not phrase:
        raise ValueError("empty phrase")
    terms = query_terms(index.entries.sparkSession, phrase, breaker or index.breaker, index)
    if not terms:
        raise ValueError("a phrase needs a token")
    if len(terms) == 1:
        return index.lookup(phrase)
    n = len(terms)

    def places(k: int) -> DataFrame:
        form, multiplier, _ = terms[k]
        rows = index.entries.where((F.col("token") == F.lit(form)) & (F.col("token") != ""))
        checked = F.when(F.col("locations").isNull(), F.raise_error(F.lit("phrase search needs locations")).cast(LOCATIONS)).otherwise(F.col("locations"))
        out = rows.withColumn("locations", checked).select("key", (F.col("weight") * multiplier).alias("_w"), F.size("locations").alias("_n"), F.inline("locations"))
        weight = F.when(F.col("_n") == 1, F.col("_w")).otherwise(F.col("contrib"))
        return out.select("key", "field_idx", "token_idx", "src_idx", "src_len", weight.alias("w"))

    runs = places(0).select("key", "field_idx", "token_idx", "src_idx", "w", F.lit(0).alias("stop"))
    for k in range(1, n):
        # several tokens may share a place; one of them is taken
        one = places(k).groupBy("key", "field_idx", "token_idx").agg(F.min(F.struct("src_idx", "src_len", "w")).alias("x"))
        one = one.select("key", "field_idx", (F.col("token_idx") - k).alias("token_idx"), F.col("x.w").alias("w2"), (F.col("x.src_idx") + F.col("x.src_len")).alias("stop2"))
        runs = runs.join(one, ["key", "field_idx", "token_idx"]).select("key", "field_idx", "token_idx", "src_idx", (F.col("w") + F.col("w2")).alias("w"), F.col("stop2").alias("stop"))
    weight = run(F.col("w"), n) if run is not None else F.col("w") * float(2 ** (n - 1))
    runs = runs.withColumn("w", positive(weight))
    span = F.struct("field_idx", "token_idx", "src_idx", (F.col("stop") - F.col("src_idx")).alias("src_len"), F.col("w").alias("contrib"))
    return runs.groupBy("key").agg(positive(combined(F.col("w"), final)).alias("weight"), F.sort_array(F.collect_list(span)).alias("locations"))


def combine_results(results: list[DataFrame], how: Combiner = "sum") -> DataFrame:
    """Union of results with equal keys combined; a combined weight of 0 or less is an error."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("key").agg(positive(combined(F.col("weight"), how)).alias("weight"), joined_locations(F.col("locations")).alias("locations"))


def ranked(results: DataFrame, k: int | None = None) -> DataFrame:
    """Best first, ties by key; the k best if k is given (a top-k, without a full sort)."""
    out = results.orderBy(F.desc("weight"), "key")
    return out if k is None else out.limit(k)


def with_source(results: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Results beside the rows they came from."""
    return results.withColumnRenamed("key", key).join(table, key)


def snippets(results: DataFrame, table: DataFrame, key: str, text: Column | str, field_idx: int = 0, before: int = 0, after: int = 0) -> DataFrame:
    """The text at each location of a field, with so many characters around it."""
    places = results.select(F.col("key").alias("_key"), F.inline("locations")).where(F.col("field_idx") == field_idx)
    rows = places.join(table.select(F.col(key).alias("_key"), (F.expr(text) if isinstance(text, str) else text).alias("_text")), "_key")
    start = F.greatest(F.lit(1), F.col("src_idx") + 1 - before)
    cut = F.substring("_text", start, F.col("src_idx") + 1 + F.col("src_len") + after - start)
    return rows.select(F.col("_key").alias("key"), "token_idx", "src_idx", "src_len", cut.alias("snippet"))
