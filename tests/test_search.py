"""Goldens of tokenisers, normalisers, index and searches."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import normalise
from lexigrain.functions.normalise import CaseNormaliser, DefaultNormaliser, PluralNormaliser, StemmingNormaliser, stop_words, suffix
from lexigrain.operators.fields import Field, with_stop_words
from lexigrain.operators.index import Index, build_index, get_or_fail, map_values, put, remove_tokens
from lexigrain.operators.search import combine_results, partial_match, phrase_match, ranked, snippets, with_source
from lexigrain.operators.tokenise import ExtendingBreaker, FragmentBreaker, NgramBreaker, SplitBreaker, WhitespaceBreaker, default_breaker


def tokens(spark, breaker, text):
    rows = breaker.break_text(spark.createDataFrame([(0, text)], "_row int, text string")).collect()
    return sorted((r["token"], r["token_idx"], r["src_idx"], r["src_len"]) for r in rows)


def test_breakers(spark):
    assert tokens(spark, WhitespaceBreaker(), " one    two\r\nthree four ") == sorted([("one", 0, 1, 3), ("two", 1, 8, 3), ("three", 2, 13, 5), ("four", 3, 19, 4)])
    assert tokens(spark, WhitespaceBreaker(wrapped=SplitBreaker("-")), " lower-cased  content ") == sorted([("lower", 0, 1, 5), ("cased", 1, 7, 5), ("content", 2, 14, 7)])
    assert tokens(spark, ExtendingBreaker("_"), "a_b c") == [("a", 0, 0, 1), ("b", 1, 2, 1), ("c", 2, 4, 1)]
    assert tokens(spark, default_breaker(), "don't, follow-up (x)") == sorted([("don't", 0, 0, 5), ("follow-up", 1, 7, 9), ("x", 2, 18, 1)])
    assert tokens(spark, NgramBreaker(3, WhitespaceBreaker()), "one two three") == sorted([("one", 0, 0, 3), ("two", 1, 4, 3), ("three", 2, 8, 5), ("one two", 0, 0, 7), ("two three", 1, 4, 9), ("one two three", 0, 0, 13)])
    assert tokens(spark, WhitespaceBreaker(), "  ") == []
    with pytest.raises(ValueError):
        NgramBreaker(0, WhitespaceBreaker())


def test_fragments(spark):
    def cut(text, *args, **kw):
        rows = FragmentBreaker(*args, WhitespaceBreaker(), **kw).break_text(spark.createDataFrame([(0, text)], "_row int, text string")).collect()
        return sorted((r["token"], round(r["multiplier"], 4)) for r in rows)

    assert cut("abcd", 2, 3, True) == [("ab", 0.5), ("abc", 0.75), ("abcd", 1.0)]
    assert cut("aaa", 1, 2, False) == [("a", 0.3333)] * 3 + [("aa", 0.6667)] * 2 + [("aaa", 1.0)]
    assert cut("a-bc", 1, 2, True, pre="-", weight=lambda t, f: F.when(f == "a", 0.0).otherwise(0.5)) == [("a-bc", 1.0), ("b", 0.5), ("bc", 0.5)]


def forms(spark, normaliser, words):
    table = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    rows = normaliser.add(table, "w", "f").select("i", "f", normaliser(F.col("w")).alias("g")).collect()
    assert all(r["f"] == r["g"] for r in rows)
    assert all(r["f"] == normaliser.form(w) for r, w in zip(sorted(rows, key=lambda r: r["i"]), words) if w is not None)
    return [r["f"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("pair", "cat/cats category/categories child/children medium/media cactus/cactii formula/formulae formula/formulas index/indexes index/indices matrix/matrices vertex/vertices datum/data man/men woman/women one/ones rune/runes tome/tomes technique/techniques".split())
def test_plural_pairs(spark, pair):
    one, many = forms(spark, PluralNormaliser(before=None), pair.split("/"))
    assert one == many


def test_normalisers(spark):
    words = ["Cat", "mangé", "résumé", "Über", "café", "don't", "follow-up", "they", "the", "bus", "by", "me", "us", "classes", "class", "tries", "trie", "trees", "tree", "houses", "house", "cats~", "-", None]
    assert forms(spark, DefaultNormaliser(), words[:7]) == ["cat", "mange", "re sume", "u ber", "cafe", "dont", "followup"]
    assert forms(spark, PluralNormaliser(), words[2:]) == ["re su~", "u ber~", "cafe~", "dont~", "followup~", "the~", "the~", "b~", "b~", "me~", "u~", "clas~", "clas~", "tr~", "trie~", "tre~", "tree~", "hou~", "house~", "cats~", "", None]
    assert forms(spark, CaseNormaliser(), ["AbC"]) == ["abc"]
    odd = ["ĳsbeer ½ Ǆ ﬁn", "Ａｂ ①", "Ṩệ ϓ", "가각", "áb", "a\r\nb\tc", "ﷺ", "x²", "…!"]
    by_char = []
    for text in odd:
        out = ""
        for c in unicodedata.normalize("NFKD", text):
            if unicodedata.category(c).startswith("P"):
                continue
            out += " " if c in "\r\n\t" or unicodedata.category(c) == "Mn" else c
        by_char.append(" ".join(x for x in out.split(" ") if x).lower())
    assert [DefaultNormaliser(full=True).form(x) for x in odd] == by_char
    assert [r[0] for r in DefaultNormaliser(full=True).add(spark.createDataFrame([(x,) for x in odd], "w string").coalesce(1), "w", "f").select("f").collect()] == by_char
    keep = [i for i, t in enumerate(odd) if t != "가각"]
    assert forms(spark, DefaultNormaliser(), [odd[i] for i in keep]) == [by_char[i] for i in keep]
    custom = StemmingNormaliser((suffix("eep", "eepzies"),), None)
    again = normalise.from_spec(custom.spec())
    assert forms(spark, again, ["sheep"]) == forms(spark, again, ["sheepzies"]) == ["sh~"]
    assert len(stop_words("EN")) == 33 and stop_words("xx") == ()
    with pytest.raises(ValueError):
        stop_words(" ")
    with pytest.raises(ValueError):
        suffix("a", " ")


POSTS = [(1, "One", "This is a post about a cat."), (2, "Two", "A follow-up post, also about cats. Cats are the best."), (3, "Three", "Today I talk about dogs.")]


@pytest.fixture(scope="module")
def posts(spark):
    table = spark.createDataFrame(POSTS, "id int, title string, content string")
    words = stop_words("en")
    n = PluralNormaliser()
    return build_index(table, "id", [Field("title", with_stop_words(5, words, n)), Field("content", with_stop_words(1, words, n))])


def listed(df):
    return {r["key"]: round(r["weight"], 6) for r in df.collect()}


def test_posts(posts):
    entries = {(r["token"], r["key"]): (round(r["weight"], 6), [tuple(x) for x in r["locations"]]) for r in posts.validated().entries.collect()}
    assert entries["cat~", 1] == (1, [(1, 6, 23, 3, 1)])
    assert entries["cat~", 2] == (2, [(1, 5, 29, 4, 1), (1, 6, 35, 4, 1)])
    assert entries["a~", 1] == (0.02, [(1, 2, 8, 1, 0.01), (1, 5, 21, 1, 0.01)])
    assert entries["o~", 1] == (5, [(0, 0, 0, 3, 5)])
    assert entries["followup~", 2] == (1, [(1, 1, 2, 9, 1)])
    assert listed(partial_match(posts, "cat posts")) == {1: 2, 2: 3}
    assert [r["key"] for r in ranked(partial_match(posts, "cat posts")).collect()] == [2, 1]
    assert listed(partial_match(posts, "cat cat")) == {1: 2, 2: 4}
    assert listed(partial_match(posts, "the cat")) == {2: 2.01}
    assert listed(partial_match(posts, "talk about")) == {3: 2}
    assert listed(partial_match(posts, "cat - posts")) == {} == listed(partial_match(posts, " "))
    assert listed(partial_match(posts, "cat dogs", mode="any")) == {1: 1, 2: 2, 3: 1}
    assert listed(partial_match(posts, "cat post about", mode=2)) == {1: 3, 2: 4}
    assert listed(partial_match(posts, "cat post", combiner=lambda found, n: F.when(F.size(found) == n, 7.0).otherwise(0.0))) == {1: 7, 2: 7}
    with pytest.raises(ValueError):
        posts.lookup(" ")


FULL = [
    (30, "The Full Text Indexer goes international!", "Pushing on"),
    (31, "The Full Text Indexer - Adding and Subtracting", "The Full Text Indexer has more - Index Generator Index TSource Adding"),
]


def test_phrases(spark, posts):
    n = PluralNormaliser()
    words = stop_words("en")
    index = build_index(spark.createDataFrame(FULL, "id int, title string, content string"), "id", [Field("title", with_stop_words(1, words, n)), Field("content", with_stop_words(1, words, n))])
    found = {r["key"]: (r["weight"], [tuple(x)[:4] for x in r["locations"]]) for r in phrase_match(index, "Full Text Indexer").collect()}
    assert found == {30: (12, [(0, 1, 4, 17)]), 31: (24, [(0, 1, 4, 17), (1, 1, 4, 17)])}
    got = phrase_match(index, "Adding and Subtracting").collect()
    assert [(r["key"], round(r["weight"], 6), [tuple(x)[:4] for x in r["locations"]]) for r in got] == [(31, 8.04, [(0, 5, 24, 22)])]
    assert listed(phrase_match(index, "Text Full")) == {}
    assert listed(phrase_match(posts, "cat")) == {1: 1, 2: 2}
    assert listed(phrase_match(posts, "cats cats")) == {2: 4}
    assert listed(phrase_match(index, "+Full")) == {}
    with pytest.raises(ValueError):
        phrase_match(index, " ")


def test_index_algebra(spark, posts):
    other = build_index(spark.createDataFrame([(2, "cat"), (9, "cat cat")], "id int, t string"), "id", [Field("t")])
    assert listed(posts.combine([other]).lookup("cat")) == {1: 1, 2: 3, 9: 2}
    assert listed(posts.combine([other, other], "avg").lookup("cat")) == {1: 1, 2: (1.5 + 1) / 2, 9: 2}
    added = posts.add(other.entries)
    assert sorted((r["key"], r["weight"]) for r in added.lookup("cat").collect()) == [(1, 1), (2, 1), (2, 2), (9, 2)]
    assert listed(added.remove_where("key = 2").lookup("cat")) == {1: 1, 9: 2}
    assert listed(posts.remove_keys(spark.createDataFrame([(2,), (2,)], "key int")).lookup("cat")) == {1: 1}
    assert posts.locations_available().first()[0] is True
    bare = build_index(spark.createDataFrame([(2, "cat")], "id int, t string"), "id", [Field("t")], capture_locations=False)
    assert bare.locations_available().first()[0] is False
    assert [r["locations"] for r in posts.combine([bare]).lookup("cat").where("key = 2").collect()] == [None]
    assert Index(posts.entries.limit(0)).locations_available().first()[0] is True
    assert listed(combine_results([posts.lookup("cat"), posts.lookup("post")])) == {1: 2, 2: 3}
    assert posts.vocabulary().count() == posts.to_dictionary().count()
    with pytest.raises(ValueError):
        Index(posts.entries.withColumn("weight", F.lit(0.0))).validated()


def test_sources_of_results(spark, posts):
    table = spark.createDataFrame(POSTS, "id int, title string, content string")
    assert sorted((r["id"], r["title"]) for r in with_source(posts.lookup("cat"), table, "id").collect()) == [(1, "One"), (2, "Two")]
    got = snippets(posts.lookup("cat"), table, "id", "content", 1, 2, 1).collect()
    assert sorted(r["snippet"] for r in got) == [". Cats ", "a cat.", "t cats."]


def test_field_numbers(spark):
    rows = [(1, "Immutable lists", ["c#", "data structures"], "Lists that never change, and trees.", "Dan"), (2, "Penguins", [], "The penguin and Dan walk.", "Dan"), (3, "  ", ["birds"], "A bird list", "Ann"), (4, None, None, None, "")]
    table = spark.createDataFrame(rows, "id int, title string, tags array<string>, body string, author string")
    index = build_index(table, "id", [Field("title", 15), Field("tags", 3), Field("body"), Field("author", 0.1)], breaker=WhitespaceBreaker("<>[](){}.,"))
    got = {(r["token"], r["key"]): (round(r["weight"], 6), [tuple(x) for x in r["locations"]]) for r in index.entries.collect()}
    assert got["list~", 1] == (16, [(0, 1, 10, 5, 15), (3, 0, 0, 5, 1)]) and got["list~", 3] == (1, [(2, 2, 7, 4, 1)])
    assert got["dan~", 1] == (0.1, [(4, 0, 0, 3, 0.1)]) and got["dan~", 2] == (1.1, [(1, 3, 16, 3, 1), (2, 0, 0, 3, 0.1)])
    assert got["bird~", 3] == (4, [(1, 0, 0, 5, 3), (2, 1, 2, 4, 1)]) and got["datum~", 1] == (3, [(2, 0, 0, 4, 3)])


def test_token_tables(spark):
    n = CaseNormaliser()
    table = spark.createDataFrame([("a", 1), ("b", 3)], "token string, value int")
    new = put(table, spark.createDataFrame([("A", 5, 0), ("c", 2, 1), ("C", 7, 2)], "token string, value int, seq int"), n)
    assert {r["token"]: r["value"] for r in new.collect()} == {"a": 5, "b": 3, "c": 7}
    assert {r["token"]: r["value"] for r in put(table, spark.createDataFrame([("A", 5, 0)], "token string, value int, seq int"), n, "sum").collect()} == {"a": 6, "b": 3}
    assert get_or_fail(new, "C", n) == 7
    with pytest.raises(KeyError):
        get_or_fail(new, "zz", n)
    assert remove_tokens(new, spark.createDataFrame([("A",)], "token string"), n).count() == 2
    assert {r["token"]: r["value"] for r in map_values(new, lambda v: F.when(v > 3, v * 2)).collect()} == {"a": 10, "c": 14}
