"""The queries of the driver contract for the index and search operators, and the SQL they equal.

Searches read an index of documents that is built once for a session and table folder, and saved
sorted by token in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import collections as lists
from lexigrain.functions.normalise import PLURALS, SPACE, DefaultNormaliser, PluralNormaliser, Suffix, fold_tables, stop_words
from lexigrain.operators.fields import Field, with_stop_words
from lexigrain.operators.index import Index, build_index, map_values, occurrences, put, remove_tokens
from lexigrain.operators.search import combine_results, partial_match, phrase_match, ranked, snippets, with_source
from lexigrain.operators.tokenise import DEFAULT_BREAKS, ExtendingBreaker, FragmentBreaker, NgramBreaker, SplitBreaker, WhitespaceBreaker, default_breaker, escaped
from lexigrain.plans.auto import AutoIndexer
from lexigrain.plans.evaluate import Querier
from lexigrain.sources import store
from lexigrain.sources.relations import group_join
from lexigrain.streaming.maintain import Maintainer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_built: dict[tuple[str, str], Index] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLURAL = PluralNormaliser()
TEXT = [Field("text", with_stop_words(1.0, stop_words("en"), PLURAL))]


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = f"{store.workspace(spark)}/lexigrain-index-{uuid.uuid4().hex}"
        store.write_parquet(build_index(table(spark, sf_dir, "documents"), "doc_id", TEXT), path)
        _built[key] = store.read(spark, path)
    return _built[key]


# SQL building blocks

_MARKED, _SINGLE, _ = fold_tables(0x250)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_default(x: str) -> str:
    folded = f"translate(regexp_replace({x}, '([{''.join(_MARKED)}])', '\\1 ', 'g'), {_quoted(''.join(_MARKED) + ''.join(_SINGLE))}, {_quoted(''.join(_MARKED.values()) + ''.join(_SINGLE.values()))})"
    return rf"lower(trim(regexp_replace(regexp_replace({folded}, '\p{{P}}+', '', 'g'), '[\r\n\t\p{{Mn}} ]+', ' ', 'g'), ' '))"


def sql_plural(x: str) -> str:
    cases = [f"WHEN {x} = '' OR ends_with({x}, '~') THEN {x}"]
    for rule in PLURALS:
        if isinstance(rule, Suffix):
            cases += [f"WHEN ends_with({x}, '{e}') AND length({x}) > {len(e)} THEN left({x}, length({x}) - {len(e)}) || '~'" for e in rule.endings]
        else:
            cases.append(f"WHEN {x} IN ({', '.join(map(_quoted, rule.words))}) THEN '{rule.words[0]}~'")
    return f"CASE {' '.join(cases)} ELSE {x} || '~' END"


def sql_tokens(source: str, keys: str = "key", characters: str = DEFAULT_BREAKS) -> str:
    """CTEs ending in toks(keys, token, token_idx, src_idx, src_len) over source(keys, text)."""
    return rf"""
    src AS ({source}),
    pieces AS (SELECT {keys}, unnest(p) AS token, generate_subscripts(p, 1) AS pos FROM (SELECT {keys}, string_split_regex(text, '[{SPACE}{escaped(characters)}]') AS p FROM src)),
    placed AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS src_idx FROM pieces),
    toks AS (SELECT {keys}, token, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS INTEGER) AS token_idx, CAST(src_idx AS INTEGER) AS src_idx, CAST(length(token) AS INTEGER) AS src_len FROM placed WHERE token <> '')"""


STOPS = ", ".join(_quoted(w) for w in sorted({PLURAL.form(w) for w in stop_words("en")}))


def sql_index(source: str = "SELECT doc_id AS key, text FROM documents") -> str:
    """CTEs ending in occ(token, key, token_idx, src_idx, src_len, w) and idx(token, key, weight, n)."""
    return f"""{sql_tokens(source)},
    forms AS (SELECT raw, {sql_plural("d")} AS form FROM (SELECT token AS raw, {sql_default("token")} AS d FROM (SELECT DISTINCT token FROM toks))),
    occ AS (SELECT form AS token, key, token_idx, src_idx, src_len, CASE WHEN form IN ({STOPS}) THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS w FROM toks JOIN forms ON raw = toks.token WHERE form <> ''),
    idx AS (SELECT token, key, sum(w) AS weight, count(*) AS n FROM occ GROUP BY token, key)"""


WITH_INDEX = "WITH " + sql_index()


def sql_form(term: str) -> str:
    return _quoted(PLURAL.form(term))


def sql_lookup(term: str) -> str:
    return f"SELECT key, weight FROM idx WHERE token = {sql_form(term)}"


def sql_all(*terms: str) -> str:
    values = ", ".join(f"({i}, {sql_form(t)})" for i, t in enumerate(terms))
    return f"SELECT key, sum(weight) AS weight FROM idx JOIN (VALUES {values}) q(i, form) ON form = token GROUP BY key HAVING count(DISTINCT i) = {len(terms)}"


def sql_runs(*terms: str) -> str:
    """One row per run of a phrase."""
    joins = " ".join(f"JOIN occ o{k} ON o{k}.key = o0.key AND o{k}.token = {sql_form(t)} AND o{k}.token_idx = o0.token_idx + {k}" for k, t in enumerate(terms) if k)
    n = len(terms)
    total = " + ".join(f"o{k}.w" for k in range(n))
    return f"SELECT o0.key, o0.token_idx, o0.src_idx, o{n - 1}.src_idx + o{n - 1}.src_len - o0.src_idx AS src_len, ({total}) * {2 ** (n - 1)} AS w FROM occ o0 {joins} WHERE o0.token = {sql_form(terms[0])}"


def sql_phrase(*terms: str) -> str:
    return f"SELECT key, sum(w) AS weight FROM ({sql_runs(*terms)}) GROUP BY key"


def weights(results: DataFrame) -> DataFrame:
    return results.select("key", F.round("weight", 6).alias("weight"))


def sql_weights(body: str) -> str:
    return f"{WITH_INDEX} SELECT key, round(weight, 6) AS weight FROM ({body})"


# Tokenisers and normalisers


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("_row", F.col("key"))


_TOKEN = ("key", "token", "token_idx", "src_idx", "src_len")
_BENCH = "SELECT item_id AS key, text FROM benchmark"


@query(f"WITH {sql_tokens(_BENCH)} SELECT * FROM toks")
def tokenise_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_breaker().break_text(_texts(spark, sf_dir, "benchmark", "item_id", "text")).select(*_TOKEN)


@query(f"WITH {sql_tokens(_BENCH, characters='e')} SELECT * FROM toks")
def tokenise_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WhitespaceBreaker(wrapped=SplitBreaker("e")).break_text(_texts(spark, sf_dir, "benchmark", "item_id", "text")).select(*_TOKEN)


@query(f"WITH {sql_tokens(_BENCH, characters='a,')} SELECT * FROM toks")
def tokenise_extending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExtendingBreaker("a,").break_text(_texts(spark, sf_dir, "benchmark", "item_id", "text")).select(*_TOKEN)


@query(
    f"""WITH {sql_tokens(_BENCH)}, n AS (SELECT *, src_idx + src_len AS stop FROM toks)
    SELECT key, token, token_idx, src_idx, src_len FROM toks
    UNION ALL SELECT a.key, a.token || ' ' || b.token, a.token_idx, a.src_idx, b.stop - a.src_idx FROM n a JOIN n b ON a.key = b.key AND b.token_idx = a.token_idx + 1
    UNION ALL SELECT a.key, a.token || ' ' || b.token || ' ' || c.token, a.token_idx, a.src_idx, c.stop - a.src_idx FROM n a JOIN n b ON a.key = b.key AND b.token_idx = a.token_idx + 1 JOIN n c ON a.key = c.key AND c.token_idx = a.token_idx + 2"""
)
def word_ngrams_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramBreaker(3, default_breaker()).break_text(_texts(spark, sf_dir, "benchmark", "item_id", "text")).select(*_TOKEN)


_PARTS = f"WITH {sql_tokens('SELECT p_partkey AS key, p_name AS text FROM part')}"


@query(
    f"""{_PARTS} SELECT key, token, token_idx, 1.0::DOUBLE AS multiplier FROM toks
    UNION ALL SELECT key, left(token, n), token_idx, round(n / length(token), 6) FROM toks, (SELECT unnest(range(2, 5)) AS n) WHERE n < length(token)"""
)
def prefix_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FragmentBreaker(2, 4, True, default_breaker()).break_text(_texts(spark, sf_dir, "part", "p_partkey", "p_name"))
    return out.select("key", "token", "token_idx", F.round("multiplier", 6).alias("multiplier"))


@query(
    f"""{_PARTS} SELECT key, token, token_idx, 1.0::DOUBLE AS multiplier FROM toks
    UNION ALL SELECT key, token[s : s + n - 1], token_idx, round(n / length(token), 6) FROM toks, (SELECT unnest(range(3, 5)) AS n), (SELECT unnest(range(1, 200)) AS s)
    WHERE s + n - 1 <= length(token) AND n < length(token)"""
)
def substring_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FragmentBreaker(3, 4, False, default_breaker()).break_text(_texts(spark, sf_dir, "part", "p_partkey", "p_name"))
    return out.select("key", "token", "token_idx", F.round("multiplier", 6).alias("multiplier"))


def _distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_breaker().break_text(_texts(spark, sf_dir, "documents", "doc_id", "text"), positions=False).select("token").distinct()


_DOCS = "SELECT doc_id AS key, text FROM documents"


@query(f"WITH {sql_tokens(_DOCS)} SELECT token, {sql_default('token')} AS form FROM (SELECT DISTINCT token FROM toks)")
def normalise_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DefaultNormaliser().add(_distinct_tokens(spark, sf_dir), "token", "form")


@query(f"WITH {sql_tokens(_DOCS)} SELECT token, {sql_plural('d')} AS form FROM (SELECT token, {sql_default('token')} AS d FROM (SELECT DISTINCT token FROM toks))")
def normalise_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLURAL.add(_distinct_tokens(spark, sf_dir), "token", "form")


@query(f"{WITH_INDEX} SELECT token, round(sum(w), 2) AS weight, count(*) AS n FROM occ WHERE token IN ({STOPS}) GROUP BY token")
def stop_word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "documents"), "doc_id", TEXT, PLURAL, default_breaker(), positions=False)
    forms = sorted({PLURAL.form(w) for w in stop_words("en")})
    return found.where(F.col("token").isin(*forms)).groupBy("token").agg(F.round(F.sum("contrib"), 2).alias("weight"), F.count(F.lit(1)).alias("n"))


# Building


@query(f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight, n FROM idx")
def build_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"), "doc_id", TEXT)
    return index.entries.select("token", "key", F.round("weight", 6).alias("weight"), F.size("locations").cast("long").alias("n"))


@query(f"{WITH_INDEX} SELECT token, key, CAST(0 AS INTEGER) AS field_idx, token_idx, src_idx, src_len, w AS contrib FROM occ")
def build_index_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(table(spark, sf_dir, "documents"), "doc_id", TEXT).occurrences()


@query(f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight FROM idx")
def index_no_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"), "doc_id", TEXT, capture_locations=False)
    return index.entries.select("token", "key", F.round("weight", 6).alias("weight"))


_PART_FIELDS = "SELECT p_partkey AS key, 0 AS field_idx, p_name AS text, 5 AS m FROM part UNION ALL SELECT p_partkey, 1, p_brand, 2 FROM part UNION ALL SELECT p_partkey, 2, p_type, 1 FROM part"
_PART_INDEX = f"""WITH {sql_tokens(_PART_FIELDS, "key, field_idx, m")}, f AS (SELECT *, {sql_default("token")} AS d FROM toks), g AS (SELECT key, m, {sql_plural("d")} AS token FROM f)"""


@query(f"{_PART_INDEX} SELECT token, key, CAST(sum(m) AS DOUBLE) AS weight FROM g WHERE token <> '' GROUP BY token, key")
def multi_field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "part"), "p_partkey", [Field("p_name", 5), Field("p_brand", 2), Field("p_type")])
    return index.entries.select("token", "key", "weight")


@query(f"{_PART_INDEX} SELECT token, key, CAST(max(m) AS DOUBLE) AS weight FROM g WHERE token <> '' GROUP BY token, key")
def combiner_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "part"), "p_partkey", [Field("p_name", 5), Field("p_brand", 2), Field("p_type")], combiner="max")
    return index.entries.select("token", "key", "weight")


@query(f"{_PART_INDEX} SELECT token, key, round(sum(m * m) / count(*), 6) AS weight FROM g WHERE token <> '' GROUP BY token, key")
def combiner_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean_square = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x) / F.size(w)
    index = build_index(table(spark, sf_dir, "part"), "p_partkey", [Field("p_name", 5), Field("p_brand", 2), Field("p_type")], combiner=mean_square)
    return index.entries.select("token", "key", F.round("weight", 6).alias("weight"))


class Plain(DefaultNormaliser):
    """Tokens as they are."""

    def steps(self) -> list:
        return [lambda c: c]


_CONV = f"""WITH {sql_tokens("SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS f, text FROM conversations WHERE regexp_matches(text, '[^" + SPACE + "]')", "key, f")}"""


@query(f"{_CONV} SELECT key, CAST(f AS INTEGER) AS field_idx, count(*) AS n_tokens, CAST(max(src_idx) AS INTEGER) AS last_idx FROM toks GROUP BY key, f")
def field_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    found = occurrences(rows.withColumn("title", F.lit("  ")), "conv_id", [Field("title", 2), Field("turns")], Plain(), default_breaker())
    return found.groupBy("key", "field_idx").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("src_idx").alias("last_idx"))


# Index algebra


@query(f"{WITH_INDEX} SELECT token, count(*) AS n FROM idx GROUP BY token")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return index.vocabulary().join(index.entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")


@query("SELECT true AS available")
def locations_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).locations_available()


@query(f"{WITH_INDEX} SELECT token, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM idx GROUP BY token")
def to_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents_index(spark, sf_dir).to_dictionary()
    return p.select("token", F.size("postings").cast("long").alias("n"), F.col("postings")[0]["key"].alias("first_key"), F.element_at("postings", -1)["key"].alias("last_key"))


@query(sql_weights(sql_lookup("The")))
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(documents_index(spark, sf_dir).lookup("The"))


def _by_language(spark: SparkSession, sf_dir: str, where: str) -> Index:
    return build_index(table(spark, sf_dir, "documents").where(where), F.col("doc_id") % 100, TEXT)


@query(f"{WITH_INDEX} SELECT token, key % 100 AS key, round(sum(weight), 6) AS weight, CAST(sum(n) AS BIGINT) AS n FROM idx GROUP BY token, key % 100")
def combine_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _by_language(spark, sf_dir, "lang = 'en'").combine([_by_language(spark, sf_dir, "lang IN ('fr', 'de')"), _by_language(spark, sf_dir, "lang NOT IN ('en', 'fr', 'de') OR lang IS NULL")])
    return one.entries.select("token", "key", F.round("weight", 6).alias("weight"), F.size("locations").cast("long").alias("n"))


@query(f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight FROM idx UNION ALL SELECT token, key, round(weight, 6) FROM idx WHERE key % 10 = 0")
def add_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return index.add(index.entries.where("key % 10 = 0")).entries.select("token", "key", F.round("weight", 6).alias("weight"))


@query(f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight FROM idx WHERE NOT key % 3 = 1")
def remove_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).remove_where("key % 3 = 1").entries.select("token", "key", F.round("weight", 6).alias("weight"))


@query(f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight FROM idx WHERE key NOT IN (SELECT doc_id FROM labels)")
def remove_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    return documents_index(spark, sf_dir).remove_keys(keys).entries.select("token", "key", F.round("weight", 6).alias("weight"))


@query("SELECT lower(p_brand) AS token, CASE WHEN lower(p_brand) = 'new' THEN 1 ELSE CAST(max(p_size) AS BIGINT) * 2 END AS value FROM part WHERE p_brand <> 'Brand#11' GROUP BY lower(p_brand) UNION ALL SELECT 'new', 14")
def token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.functions.normalise import CaseNormaliser

    n = CaseNormaliser()
    empty = spark.createDataFrame([], "token string, value long")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("token"), F.col("p_size").cast("long").alias("value"), F.col("p_partkey").alias("seq"))
    full = put(put(empty, brands, n, "max"), spark.createDataFrame([("NEW", 7, 0)], "token string, value long, seq long"), n)
    return map_values(remove_tokens(full, spark.createDataFrame([("BRAND#11",)], "token string"), n), lambda v: v * 2)


# Searching


@query(sql_weights(sql_all("of", "the")))
def partial_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(partial_match(documents_index(spark, sf_dir), "of the"))


@query(sql_weights(f"SELECT key, sum(weight) AS weight FROM idx WHERE token IN ({sql_form('trash')}, {sql_form('der')}) GROUP BY key"))
def partial_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(partial_match(documents_index(spark, sf_dir), "trash, der", mode="any"))


@query(sql_weights(sql_all("the", "the")))
def partial_repeat_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(partial_match(documents_index(spark, sf_dir), "the the"))


@query(sql_weights(f"SELECT key, max(weight) AS weight FROM idx WHERE token IN ({sql_form('of')}, {sql_form('and')}, {sql_form('is')}) GROUP BY key HAVING count(*) >= 2"))
def partial_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(partial_match(documents_index(spark, sf_dir), "of and is", mode=2, how="max"))


@query(sql_weights(sql_phrase("of", "the")))
def phrase_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(phrase_match(documents_index(spark, sf_dir), "of the"))


@query(sql_weights(sql_phrase("of", "the", "the")))
def phrase_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(phrase_match(documents_index(spark, sf_dir), "of the the"))


@query(f"{WITH_INDEX} SELECT key, CAST(0 AS INTEGER) AS field_idx, token_idx, src_idx, CAST(src_len AS INTEGER) AS src_len, round(w, 6) AS contrib FROM ({sql_runs('and', 'the')})")
def phrase_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_match(documents_index(spark, sf_dir), "and the").select("key", F.inline("locations")).withColumn("contrib", F.round("contrib", 6))


@query(sql_weights(f"SELECT key, sum(weight) AS weight FROM ({sql_lookup('the')} UNION ALL {sql_lookup('of')}) GROUP BY key"))
def combine_match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return weights(combine_results([index.lookup("the"), index.lookup("of")]))


@query(sql_weights(f"SELECT * FROM ({sql_lookup('the')}) ORDER BY round(weight, 6) DESC, key LIMIT 20"))
def topk_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(weights(documents_index(spark, sf_dir).lookup("the")), 20)


@query(f"{WITH_INDEX} SELECT key, token_idx, text[src_idx + 1 : src_idx + src_len] AS snippet FROM ({sql_runs('of', 'the')}) JOIN documents ON doc_id = key")
def highlight_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_match(documents_index(spark, sf_dir), "of the")
    return snippets(found, table(spark, sf_dir, "documents"), "doc_id", "text").select("key", "token_idx", "snippet")


@query(f"{WITH_INDEX} SELECT doc_id, lang, source, round(weight, 6) AS weight FROM ({sql_lookup('der')}) JOIN documents ON doc_id = key")
def result_join_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_source(weights(documents_index(spark, sf_dir).lookup("der")), table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lang", "source", "weight")


# The query language


def _asked(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: weights(Querier(documents_index(spark, sf_dir)).matches(text))


def _pool(*bodies: str, where: str = "true") -> str:
    return sql_weights(f"SELECT key, sum(weight) AS weight FROM ({' UNION ALL '.join(bodies)}) WHERE {where} GROUP BY key")


def _in(term: str) -> str:
    return f"key IN (SELECT key FROM idx WHERE token = {sql_form(term)})"


for _name, _text, _sql in (
    ("bool_or", "trash der", _pool(sql_lookup("trash"), sql_lookup("der"))),
    ("bool_and", "+the +is", _pool(sql_lookup("the"), sql_lookup("is"), where=f"{_in('the')} AND {_in('is')}")),
    ("bool_not", "the -is", _pool(sql_lookup("the"), where=f"NOT {_in('is')}")),
    ("bool_nested", "+of +(is trash) -(+be +was)", _pool(sql_lookup("of"), sql_lookup("is"), sql_lookup("trash"), where=f"{_in('of')} AND ({_in('is')} OR {_in('trash')}) AND NOT ({_in('be')} AND {_in('was')})")),
    ("bool_phrase_mix", '"of the" is -"and the"', _pool(sql_phrase("of", "the"), sql_lookup("is"), where=f"key NOT IN (SELECT key FROM ({sql_runs('and', 'the')}))")),
    ("bool_empty_compulsory", '+"" the', sql_weights(f"SELECT * FROM ({sql_lookup('the')}) WHERE false")),
):
    QUERIES[_name], SQL[_name] = _asked(_text), _sql


# Sources, schema inference, helpers


@query("SELECT c_custkey, c_name, n AS n_orders, first_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey".replace("n AS n_orders", "CAST(coalesce(n, 0) AS INTEGER) AS n_orders"))
def group_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    found = group_join(table(spark, sf_dir, "customer"), orders, "c_custkey", "o_orderkey", "orders")
    return found.select("c_custkey", "c_name", F.size("orders").alias("n_orders"), F.try_element_at("orders", F.lit(1)).alias("first_order"))


_NESTED = "SELECT p_partkey AS key, 0 AS field_idx, p_type AS text, 4 AS m FROM part UNION ALL SELECT p_partkey, 1, p_name, 1 FROM part UNION ALL SELECT p_partkey, 2, p_brand, 3 FROM part UNION ALL SELECT p_partkey, 3, p_name, 3 FROM part"


@query(f"""WITH {sql_tokens(_NESTED, "key, field_idx, m")}, f AS (SELECT *, {sql_default("token")} AS d FROM toks), g AS (SELECT key, m, {sql_plural("d")} AS token FROM f)
    SELECT token, key, round(sum(CASE WHEN token IN ({STOPS}) THEN 0.01 ELSE 1 END * m), 6)::DOUBLE AS weight FROM g WHERE token <> '' GROUP BY token, key""")
def auto_index_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    nested = part.select(F.col("p_partkey").alias("id"), F.struct("p_name", F.col("p_type").alias("kind")).alias("names"), F.array(F.struct(F.col("p_brand").alias("label"), "p_size"), F.struct(F.col("p_name").alias("label"), "p_size")).alias("marks"), F.col("p_brand").alias("secret"), F.create_map(F.lit("a"), "p_name").alias("skipped"))
    indexer = AutoIndexer().weigh("marks.label", 3).weigh("kind", 4).ignore("secret").first_field("names.kind")
    return indexer.build(nested).entries.select("token", "key", F.round("weight", 6).alias("weight"))


def _roundtrip(spark: SparkSession, sf_dir: str, write: Callable) -> DataFrame:
    path = f"{store.workspace(spark)}/lexigrain-trip-{uuid.uuid4().hex}"
    write(documents_index(spark, sf_dir), path)
    return store.read(spark, path).entries.select("token", "key", F.round("weight", 6).alias("weight"), F.size("locations").cast("long").alias("n"))


_ENTRIES = f"{WITH_INDEX} SELECT token, key, round(weight, 6) AS weight, n FROM idx"


@query(_ENTRIES)
def io_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, store.write_parquet)


@query(_ENTRIES)
def io_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, store.write_json)


@query(_ENTRIES)
def io_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = store.from_json(store.as_json(documents_index(spark, sf_dir)))
    return back.select("token", "key", F.round("weight", 6).alias("weight"), F.size("locations").cast("long").alias("n"))


@query(
    """SELECT vec_id, CAST(len(e) AS INTEGER) AS n, e[3] AS third, e[-1] AS last, list_contains(e, 5) AS has_five, CAST(len(list_filter(e, lambda x: x > 0)) AS INTEGER) AS above,
        list_sort(e)[1] AS least, CAST(list_sum(list_concat(e[1:2], [7], e[3:])) AS BIGINT) AS inserted, CAST(list_sum(e[3:]) - coalesce(e[4], 0) AS BIGINT) AS removed
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 20) AS BIGINT)) AS e FROM embeddings)"""
)
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 20).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    a = F.col("e")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    return rows.select("vec_id", lists.count(a).alias("n"), lists.item(a, 2).alias("third"), lists.last(a).alias("last"), lists.contains(a, F.lit(5)).alias("has_five"), lists.count(a, lambda x: x > 0).alias("above"),
        lists.sort(a)[0].alias("least"), total(lists.insert(a, F.array(F.lit(7).cast("long")), 2)).alias("inserted"), total(lists.remove_range(lists.remove_range(a, 3), 0, 2)).alias("removed"))


@query("SELECT doc_id, lang, true AS has_lang, 'x' AS put, NULL::VARCHAR AS gone, CAST(2 AS INTEGER) AS n FROM documents")
def map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    changed = lists.map_remove(lists.map_put(m, F.lit("new"), F.lit("x")), F.lit("source"))
    return docs.select("doc_id", lists.map_get(m, F.lit("lang")).alias("lang"), lists.map_has(m, F.lit("lang")).alias("has_lang"), lists.map_get(changed, F.lit("new")).alias("put"), F.try_element_at(changed, F.lit("source")).alias("gone"), F.size(F.map_keys(changed)).alias("n"))


@query(_ENTRIES)
def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, sent twice as a batch each: the second batch replaces the first."""
    base = f"{store.workspace(spark)}/lexigrain-stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    docs.withColumn("text", F.concat(F.lit("old "), "text")).write.parquet(f"{base}/in")
    keep = Maintainer(f"{base}/index", lambda rows: build_index(rows, "doc_id", TEXT))
    stream = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
    keep.start(stream, f"{base}/checkpoint", availableNow=True).awaitTermination()
    docs.write.mode("append").parquet(f"{base}/in")
    keep.start(stream, f"{base}/checkpoint", availableNow=True).awaitTermination()
    return store.read(spark, keep.version(1)).entries.select("token", "key", F.round("weight", 6).alias("weight"), F.size("locations").cast("long").alias("n"))
