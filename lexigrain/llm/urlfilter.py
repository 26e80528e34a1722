"""URL filters by a temporal join with dated lists.

A list is a table of dated entries: at `at`, `pattern` is added to or removed from `list`. Entries
of one pattern become validity intervals [since, until): an interval opens with an addition and ends
with the next entry of the pattern. Each capture is then evaluated against the entries active when
it was fetched: an equi-join on the keys that its URL yields (every parent domain of its host, the
host itself, every path prefix that ends at a segment) and a comparison of its time with the interval.

Only matches leave the join. The intervals are broadcast if they number at most SEND; else
captures and intervals are joined by key and salt, so that a host with a third of all captures is
spread over SALTS tasks a key.

Kinds: 'domain' matches the host and its subdomains, 'host' the host alone, 'prefix' host and path
up to a slash or the end. Hosts and patterns compare in lower case, without port, user and
trailing dot; queries and fragments play no part.

Cases: a null url or time matches nothing and gives blocked false; entries with a null list, pattern, kind,
time or action are ignored; at one instant a removal wins over an addition, and repeated entries count
once; removals of what isn't listed do nothing; repeated captures give a row each; of several
matching entries the longest pattern is reported, ties by pattern, kind and list; an empty list blocks
nothing; columns of captures other than id, url and time are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEND, SALTS = 50_000, 32

#: The dated list that the query uses: at, action, kind, pattern, list.
ENTRIES = [
    ("2024-01-15", "add", "host", "www.casino-win.example.org", "gambling"),
    ("2024-06-01", "remove", "host", "www.casino-win.example.org", "gambling"),
    ("2024-09-10", "add", "host", "www.casino-win.example.org", "gambling"),
    ("2024-03-01", "add", "domain", "cheap-pills.example.com", "spam"),
    ("2024-11-20", "remove", "domain", "cheap-pills.example.com", "spam"),
    ("2024-02-01", "add", "domain", "tionsh.example.net", "adult"),
    ("2024-04-01", "remove", "domain", "tionsh.example.net", "adult"),
    ("2024-04-01", "add", "domain", "tionsh.example.net", "spam"),
    ("2024-05-05", "add", "domain", "example.net", "legal"),
    ("2024-05-25", "remove", "domain", "example.net", "legal"),
    ("2024-07-01", "add", "prefix", "ththre.example.com/fr", "legal"),
    ("2024-08-01", "add", "prefix", "ththre.example.com/fr", "legal"),
    ("2024-10-01", "remove", "prefix", "ththre.example.com/fr", "legal"),
    ("2024-01-01", "add", "prefix", "m.ththth.example.net/en/25", "spam"),
    ("2024-03-03", "remove", "host", "never.example.org", "spam"),
]


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """Every 'kind pattern' that would match the url."""
    h = host(url)
    parts = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    steps = F.filter(F.split(path(url), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(F.lit("prefix "), F.array_join(F.concat(F.array(h), F.slice(steps, F.lit(1), i)), "/")))
    return F.when(h != "", F.array_distinct(F.concat(domains, F.array(F.concat(F.lit("host "), h)), prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, kind, pattern, list, since, until (null: still listed)."""
    known = entries.select(F.col("at").cast("timestamp").alias("at"), "action", F.lower("kind").alias("kind"), F.regexp_replace("pattern", r"/+$", "").alias("pattern"), "list").where("action IN ('add', 'remove')").na.drop()
    head = F.regexp_replace(F.lower(F.substring_index("pattern", "/", 1)), r"\.+$", "")
    known = known.withColumn("pattern", F.concat(head, F.substring("pattern", F.length(F.substring_index("pattern", "/", 1)) + F.lit(1), F.length("pattern"))))
    known = known.groupBy("kind", "pattern", "list", "at").agg(F.max("action").alias("action"))  # 'remove' wins
    order = Window.partitionBy("kind", "pattern", "list").orderBy("at")
    return known.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select(F.concat_ws(" ", "kind", "pattern").alias("key"), "kind", "pattern", "list", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetch_time") -> DataFrame:
    """key, url, at, blocked, n_entries (active entries that match), kind, pattern and list of the most specific."""
    active = intervals(entries)
    rows = captures.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.col(at).alias("_at"))
    asked = rows.where("_url IS NOT NULL AND _at IS NOT NULL").distinct().withColumn("key", F.explode(keys(F.col("_url"))))
    within = (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    if active.limit(SEND + 1).count() <= SEND:
        met = asked.join(F.broadcast(active), "key").where(within)
    else:
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("_id", "_url", "_at"), F.lit(SALTS)))
        copies = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, ["key", "salt"]).where(within)
    best = F.min(F.struct((-F.length("pattern")).alias("n"), "pattern", "kind", "list"))
    hits = met.groupBy("_id", "_url", "_at").agg(F.count(F.lit(1)).alias("n_entries"), best.alias("best")).withColumn("_hit", F.lit(True)).withColumnsRenamed({"_id": "_id2", "_url": "_url2", "_at": "_at2"})
    found = rows.join(hits, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_url") == F.col("_url2")) & (F.col("_at") == F.col("_at2")), "left")
    return found.select(
        F.col("_id").alias(key), F.col("_url").alias(url), F.col("_at").alias(at), F.coalesce("_hit", F.lit(False)).alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list")
    )


def entries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "at string, action string, kind string, pattern string, list string")


def fetched(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching: the table has none, so each page_id stands for a day of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.cast("timestamp").alias("fetch_time"))


def evaluate_pages(pages: DataFrame) -> DataFrame:
    common.prepare(pages.sparkSession)
    return evaluate(fetched(pages), entries_table(pages.sparkSession))


_VALUES = ", ".join(f"(TIMESTAMP '{a}', '{b}', '{c}', '{d}', '{e}')" for a, b, c, d, e in ENTRIES)
SQL = rf"""
    WITH entries(moment, action, kind, pattern, list) AS (VALUES {_VALUES}),
    captures AS (
        SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS TIMESTAMP) AS fetch_time,
            lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
        FROM pages
    ), names AS (SELECT DISTINCT kind, pattern, list FROM entries),
    met AS (
        SELECT c.page_id, n.kind, n.pattern, n.list
        FROM captures c JOIN names n ON CASE n.kind
            WHEN 'host' THEN c.host = n.pattern
            WHEN 'domain' THEN c.host = n.pattern OR ends_with(c.host, '.' || n.pattern)
            ELSE starts_with(rtrim(c.host || c.path, '/') || '/', n.pattern || '/') END
        WHERE (SELECT e.action FROM entries e WHERE e.kind = n.kind AND e.pattern = n.pattern AND e.list = n.list AND e.moment <= c.fetch_time ORDER BY e.moment DESC LIMIT 1) = 'add'
    ), best AS (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern, kind, list) AS nth, count(*) OVER (PARTITION BY page_id) AS n FROM met
    )
    SELECT c.page_id, c.url, c.fetch_time, b.page_id IS NOT NULL AS blocked, coalesce(b.n, 0) AS n_entries, b.kind, b.pattern, b.list
    FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND b.nth = 1"""
