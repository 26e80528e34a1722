"""What keeps builds and searches within their limits as tables grow: few shuffles, code that Java compiles, bounded documents."""

import pytest
from pyspark.sql import functions as F

from lexigrain.functions.normalise import PluralNormaliser
from lexigrain.operators.fields import Field
from lexigrain.operators.index import build_index
from lexigrain.operators.tokenise import NgramBreaker, default_breaker
from lexigrain.sources import store
from lexigrain.streaming.maintain import Maintainer
from lexigrain.sources import store
from lexigrain.streaming.maintain import Maintainer

ROWS = [(i % 40, f"a cat, {i} dogs and a réad{i % 3}ed bird") for i in range(100)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, t string").repartition(3)


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_build_shuffles_texts_only(rows):
    """Texts go to their key's task once; their tokens are neither sorted for positions nor shuffled again."""
    index = build_index(rows.select("*"), "id", [Field("t")])
    own = nodes(rows, "Exchange")
    assert nodes(index.entries, "Exchange") == own + 1 and nodes(index.entries, "Window") == 0
    assert nodes(default_breaker().break_text(rows.withColumnRenamed("t", "text")), "Exchange") == own
    # rows of one key are one document all the same
    assert {r["key"]: r["weight"] for r in index.lookup("cat").collect()} == {k: sum(i % 40 == k for i in range(100)) for k in range(40)}


def test_normaliser_is_compiled(spark):
    """Java interprets methods of more than 8000 bytes."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    table = spark.createDataFrame(ROWS, "id long, token string")
    code = debug.codegenStringSeq(PluralNormaliser().add(table, "token", "token")._jdf.queryExecution().executedPlan())
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and max(sizes) < 8000


def test_positions_count_code_points(spark):
    text = "a😀b, ẍ c  😀"
    rows = default_breaker().break_text(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["token"], r["token_idx"], r["src_idx"], r["src_len"]) for r in rows] == [("a😀b", 0, 0, 3), ("ẍ", 1, 5, 1), ("c", 2, 7, 1), ("😀", 3, 10, 1)]
    runs = NgramBreaker(2, default_breaker()).break_text(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["token"], r["token_idx"], r["src_idx"], r["src_len"]) for r in runs][:3] == [("a😀b", 0, 0, 3), ("a😀b ẍ", 0, 0, 6), ("ẍ", 1, 5, 1)]


def written(path):
    return sum(p.stat().st_size for p in path.rglob("part-*"))


def test_json_takes_little_disk(spark, rows, tmp_path):
    index = build_index(rows, "id", [Field("t")])
    store.write_json(index, f"{tmp_path}/j")
    store.write_parquet(index, f"{tmp_path}/p")
    assert written(tmp_path / "j") < 3 * written(tmp_path / "p")
    want = sorted(map(str, index.entries.collect()))
    assert sorted(map(str, store.read(spark, f"{tmp_path}/j").entries.collect())) == want
    # files of the layout before, and entries without locations
    index.entries.write.option("ignoreNullFields", "false").json(f"{tmp_path}/old/entries")
    (tmp_path / "old" / "index.json").write_text(store._sidecar(index, "json"))
    assert sorted(map(str, store.read(spark, f"{tmp_path}/old").entries.collect())) == want
    store.write_json(build_index(rows, "id", [Field("t")], capture_locations=False), f"{tmp_path}/bare")
    assert {r["locations"] for r in store.read(spark, f"{tmp_path}/bare").entries.collect()} == {None}
    (tmp_path / "j" / "entries" / "part-x.json").write_text('{"token":"a~","key":1,"weight":1.0,"field_idx":[0],"token_idx":[],"src_idx":[0],"src_len":[1],"contrib":[1.0]}')
    with pytest.raises(Exception, match="different sizes"):
        store.read(spark, f"{tmp_path}/j").entries.collect()


def written(path):
    return sum(p.stat().st_size for p in path.rglob("part-*"))


def test_json_takes_little_disk(spark, rows, tmp_path):
    index = build_index(rows, "id", [Field("t")])
    store.write_json(index, f"{tmp_path}/j")
    store.write_parquet(index, f"{tmp_path}/p")
    assert written(tmp_path / "j") < 3 * written(tmp_path / "p")
    want = sorted(map(str, index.entries.collect()))
    assert sorted(map(str, store.read(spark, f"{tmp_path}/j").entries.collect())) == want
    # files of the layout before, and entries without locations
    index.entries.write.option("ignoreNullFields", "false").json(f"{tmp_path}/old/entries")
    (tmp_path / "old" / "index.json").write_text(store._sidecar(index, "json"))
    assert sorted(map(str, store.read(spark, f"{tmp_path}/old").entries.collect())) == want
    store.write_json(build_index(rows, "id", [Field("t")], capture_locations=False), f"{tmp_path}/bare")
    assert {r["locations"] for r in store.read(spark, f"{tmp_path}/bare").entries.collect()} == {None}
    (tmp_path / "j" / "entries" / "part-x.json").write_text('{"token":"a~","key":1,"weight":1.0,"field_idx":[0],"token_idx":[],"src_idx":[0],"src_len":[1],"contrib":[1.0]}')
    with pytest.raises(Exception, match="different sizes"):
        store.read(spark, f"{tmp_path}/j").entries.collect()


def test_json_documents_are_bounded(spark, rows):
    index = build_index(rows, "id", [Field("t")])
    docs = store.as_json(index, most=30).withColumn("n", F.size(F.split("json", "token_idx")) - 1).collect()
    assert max(r["n"] for r in docs) < 60
    assert len([r for r in docs if r["token"] == "cat~"]) > 1 and len([r for r in docs if r["token"] == "7~"]) == 1
    assert len([r for r in store.as_json(index).collect() if r["token"] == "cat~"]) == 1
    entries = index.entries.select("token", "key", "weight", "locations")
    back = store.from_json(store.as_json(index, most=30)).select("token", "key", "weight", "locations")
    assert sorted(map(str, back.collect())) == sorted(map(str, entries.collect()))


def changed(spark, path, batches):
    """The last version's entries after batches of (id, t)."""
    keep = Maintainer(str(path), lambda x: build_index(x, "id", [Field("t")]))
    for i, batch in enumerate(batches):
        keep.apply(spark.createDataFrame(batch, "id long, t string"), i)
    return sorted([(r["token"], r["key"], r["weight"]) for r in store.read(spark, keep.version(len(batches) - 1)).entries.collect()], key=str)


def test_versions(spark, tmp_path):
    first = [(i, f"cat t{i}") for i in range(6)]
    of = lambda rows: sorted([(f"{PluralNormaliser().form(w)}", k, 1.0) for k, t in rows for w in t.split()], key=str)
    for name, second in (("few", [(1, "dog")]), ("most", [(i, "dog") for i in range(5)]), ("all", [(i, "dog") for i in range(6)]), ("none", [(9, "dog")])):
        ids = {k for k, _ in second}
        assert changed(spark, tmp_path / name, [first, second]) == of([r for r in first if r[0] not in ids] + second)
    got = changed(spark, tmp_path / "null", [[*first, (None, "owl")], [(i, "dog") for i in range(5)]])
    assert got == sorted([*of([(i, "dog") for i in range(5)] + first[5:]), ("owl~", None, 1.0)], key=str)


def test_a_replaced_version_shuffles_no_entries(spark, tmp_path):
    """Entries of an index that a batch replaces are not shuffled to find out, and the batch is indexed once."""
    calls = spark.sparkContext.accumulator(0)

    def build(x):
        seen = F.udf(lambda t: calls.add(1) or t)
        return build_index(x.withColumn("t", seen("t")), "id", [Field("t")])

    keep = Maintainer(str(tmp_path), build)
    batch = spark.createDataFrame([(i, "a cat") for i in range(20)], "id long, t string")
    keep.apply(batch, 0)
    once = calls.value
    keep.apply(batch, 1)
    assert calls.value == 2 * once


def test_combining_shuffles_texts_only(spark):
    """Indexes that were built by key are combined where their entries are."""
    made = [build_index(spark.createDataFrame(ROWS, "id long, t string"), "id", [Field("t")]) for _ in range(3)]
    both = made[0].combine(made[1:])
    assert nodes(both.entries, "Exchange") == 3
    assert {(r["token"], r["key"]): r["weight"] for r in both.entries.collect()} == {(r["token"], r["key"]): 3 * r["weight"] for r in made[0].entries.collect()}


def test_a_frequent_token_is_in_all_files(spark, tmp_path):
    """A search for it gives each task a part of its rows; files are sorted by token all the same."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_parquet(build_index(spark.createDataFrame(ROWS, "id long, t string"), "id", [Field("t")]), f"{tmp_path}/p")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "p" / "entries").glob("part-*"))
    held = [[r["token"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > 2 and all("cat~" in x and x == sorted(x) for x in held)
