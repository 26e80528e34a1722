"""Goldens of the query language, schema inference, storage, streams, loggers and list helpers."""

import io

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import collections as lists
from lexigrain.logs import Combined, Filtered, Quiet, Writer
from lexigrain.operators.fields import Field
from lexigrain.operators.index import build_index
from lexigrain.plans.auto import AutoIndexer
from lexigrain.plans.evaluate import Querier
from lexigrain.plans.parser import Combining, Compulsory, Excluding, NoMatch, Precise, Standard, parse
from lexigrain.sources import store

S, P, C, X = Standard, Precise, Compulsory, Excluding


def any_of(*parts):
    return Combining(parts)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        (" test ", S("test")),
        ('"test test"', P("test test")),
        (r'"test\"test"', P('test"test')),
        ("test0 (test1 (test2 test3)) test4", any_of(S("test0"), any_of(S("test1"), any_of(S("test2"), S("test3"))), S("test4"))),
        ("test0(test1 test2)", any_of(S("test0"), any_of(S("test1"), S("test2")))),
        (r"test0\(test1 test2\)", any_of(S("test0(test1"), S("test2)"))),
        ('+"test0 test1"', C(P("test0 test1"))),
        ("+(test0 test1)", C(any_of(S("test0"), S("test1")))),
        ("+fruit +nut +(apples pears bananas) -orange", any_of(C(S("fruit")), C(S("nut")), C(any_of(S("apples"), S("pears"), S("bananas"))), X(S("orange")))),
        ("follow-up a+b", any_of(S("follow-up"), S("a+b"))),
        (r"\(foo", S("foo")),
        (r"\+foo", S("+foo")),
        (r"\ +foo", S("+foo")),
        (r"\\foo", S("foo")),
        ("foo\\", S("foo")),
        ("+", C(NoMatch())),
        ("++foo", C(C(S("foo")))),
        ("+-foo", C(X(S("foo")))),
        ("-+foo", X(C(S("foo")))),
        ("(+) x", C(S("x"))),
        ("(a +) b)", any_of(S("a"), C(S("b")))),
        ('ab"c d"', any_of(S('ab"c'), S('d"'))),
        ('"a"b', any_of(P("a"), S("b"))),
        ("(a b", any_of(S("a"), S("b"))),
        ("a) b", any_of(S("a"), S("b"))),
        ("()", NoMatch()),
        ("", NoMatch()),
    ],
)
def test_parser(query, tree):
    assert parse(query) == tree


def test_blank_phrase_is_an_error():
    with pytest.raises(ValueError):
        parse('"   "')


ROWS = [(1, "a cat sat", "x y"), (2, "a dog sat", "cat"), (3, "the dog", "z")]


def test_querier(spark):
    index = build_index(spark.createDataFrame(ROWS, "id int, t string, u string"), "id", [Field("t"), Field("u")])
    ask = Querier(index)
    got = lambda q: {r["key"]: r["weight"] for r in ask.matches(q).collect()}
    assert got("cat dog") == {1: 1, 2: 2, 3: 1}
    assert got("+sat -dog") == {1: 1}
    assert got('"dog sat" (z -z)') == {2: 4}
    assert got('+"" cat') == {} == got("-cat")
    with pytest.raises(ValueError):
        ask.matches(" ")
    mean = Querier(index, combiner=lambda w, n: F.aggregate(w, F.lit(0.0), lambda a, b: a + b) / n)
    assert {r["key"]: r["weight"] for r in mean.matches("cat dog").collect()} == {1: 0.5, 2: 1, 3: 0.5}


def test_schema_inference_and_storage(spark, tmp_path):
    table = spark.sql("SELECT 1 AS Id, 'red cats' AS title, named_struct('name', 'Ann', 'tags', array('b c', ' ')) AS who, array(named_struct('t', 'deep')) AS list, array(array('no')) AS nested, map('a', 'b') AS m, 'gone' AS note")
    auto = AutoIndexer().weigh("name", 3).weigh("title", 2).ignore("note").first_field("who.name")
    assert auto.key_of(table.columns) == "Id"
    assert [p for p, _ in auto.paths(table.schema)] == ["who.name", "title", "who.tags", "list.t", "note"]
    index = auto.build(table)
    # "by" is a stop word of the form b~, so "b" weighs as one
    want = {("ann~", 3.0, 0), ("red~", 2.0, 1), ("cat~", 2.0, 1), ("b~", 0.01, 2), ("c~", 1.0, 2), ("deep~", 1.0, 3)}
    assert {(r["token"], r["weight"], r["field_idx"]) for r in index.occurrences().join(index.entries.select("token", "weight"), "token").collect()} == want
    with pytest.raises(ValueError):
        AutoIndexer().key_of(["x"])
    with pytest.raises(ValueError):
        AutoIndexer().weigh("a", 0)
    rows = sorted(map(str, index.entries.collect()))
    for kind, write in (("p", store.write_parquet), ("j", store.write_json)):
        write(index, f"{tmp_path}/{kind}")
        back = store.read(spark, f"{tmp_path}/{kind}")
        assert sorted(map(str, back.entries.collect())) == rows and back.normaliser == index.normaliser
    assert sorted(map(str, store.from_json(store.as_json(index), "int").select("token", "key", "weight", "locations").collect())) == rows
    (tmp_path / "p" / "index.json").write_text("{}")
    with pytest.raises(store.IndexFormatError):
        store.read(spark, f"{tmp_path}/p")


def test_loggers():
    out = io.StringIO()

    class Broken(Writer):
        def log(self, *_args):
            raise OSError

    log = Combined((Filtered.of(Writer(out), ["warning"]), Quiet(Broken(out))))
    log.debug("no")
    log.warning(lambda: "yes")
    assert out.getvalue().endswith("[warning] yes\n") and out.getvalue().count("\n") == 1


def test_lists(spark):
    a = F.array(*[F.lit(x) for x in (3, 1, 3, 2)])
    row = spark.range(1).select(
        lists.remove_first(a, F.lit(3)).alias("first"), lists.remove_last(a).alias("cut"), lists.insert(a, F.array(F.lit(9)), 4).alias("end"),
        lists.sort(a, lambda x: x % 2).alias("stable"), lists.remove_where(a, lambda x: x == 3).alias("without"), lists.remove_first(a, F.lit(7)).alias("same"), lists.any_of(a, lambda x: x > 2).alias("any"),
    ).first()
    assert [list(x) if isinstance(x, list) else x for x in row] == [[1, 3, 2], [3, 1, 3], [3, 1, 3, 2, 9], [2, 3, 1, 3], [1, 2], [3, 1, 3, 2], True]
