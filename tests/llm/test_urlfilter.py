from datetime import datetime, timedelta

import pytest

from lexigrain.llm import common, urlfilter


def duck(sql, sf="/root/testdata/sf0.01"):
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.execute(sql).fetchall()


def test_equals_sql(spark):
    found = urlfilter.evaluate_pages(common.table(spark, "/root/testdata/sf0.01", "pages")).collect()
    want = sorted(duck(urlfilter.SQL))
    assert sorted(map(tuple, found)) == want
    assert 5 < sum(r["blocked"] for r in found) < len(found) / 2


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


CAPTURES = [
    (1, "http://a.x.org/p/q?z#f", day(5)),
    (2, "HTTPS://user@A.X.ORG.:8080/p", day(15)),
    (3, "http://x.org/", day(5)),
    (4, "http://notx.org/", day(5)),
    (5, "http://a.x.org/pq", day(5)),
    (6, None, day(5)),
    (7, "http://x.org", None),
    (8, "no url", day(5)),
    (9, "http://x.org/p", day(10)),
    (9, "http://x.org/p", day(10)),
    (10, "http://a.x.org//p//q/r", day(5)),
    (None, "http://x.org/" + "s/" * 2000, day(4)),
]
ENTRIES = [
    (day(4), "add", "domain", "X.org.", "l1"),
    (day(10), "remove", "domain", "x.org", "l1"),
    (day(10), "add", "domain", "x.org", "l1"),
    (day(0), "add", "prefix", "a.x.org/p/", "l2"),
    (day(0), "add", "prefix", "a.x.org/p", "l2"),
    (day(20), "add", "host", "a.x.org", "l3"),
    (day(0), "add", None, "x.org", "l4"),
    (None, "add", "host", "x.org", "l4"),
    (day(1), "remove", "host", "x.org", "l4"),
]
WANT = {1: (2, "a.x.org/p"), 2: (1, "a.x.org/p"), 3: (1, "x.org"), 4: (0, None), 5: (1, "x.org"), 6: (0, None), 7: (0, None), 8: (0, None), 9: (0, None), 10: (2, "a.x.org/p"), None: (1, "x.org")}


@pytest.mark.parametrize("send", [50_000, 0])
def test_cases(spark, monkeypatch, send):
    monkeypatch.setattr(urlfilter, "SEND", send)
    captures = spark.createDataFrame([(*c, "k", True) for c in CAPTURES], "page_id long, url string, fetch_time timestamp, key string, blocked boolean")
    entries = spark.createDataFrame(ENTRIES, "at timestamp, action string, kind string, pattern string, list string")
    found = urlfilter.evaluate(captures, entries).collect()
    assert len(found) == len(CAPTURES)
    assert {r["page_id"]: (r["n_entries"], r["pattern"]) for r in found} == WANT
    assert all(r["blocked"] == (r["n_entries"] > 0) for r in found)
    assert not any(r["blocked"] for r in urlfilter.evaluate(captures, entries.limit(0)).collect())
    assert urlfilter.evaluate(captures.limit(0), entries).count() == 0
