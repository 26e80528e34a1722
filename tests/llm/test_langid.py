import zlib

import numpy as np
import pytest

from lexigrain.llm import common, langid


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.held_out_predictions(docs).collect()
    assert {r["doc_id"] for r in found} == set(truth) and len(found) == len(truth)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found} <= {x for x in truth.values() if x is not None} | {"und"}
    own = [r for r in found if r["held_out"] and truth[r["doc_id"]] is not None]
    right = np.array([r["lang_pred"] == truth[r["doc_id"]] for r in own])
    score = np.array([r["score"] for r in own])
    assert len(own) > 1000 and right.mean() > 0.97
    # calibrated: where scores are high, predictions are right about as often as they say
    assert abs(right[score > 0.9].mean() - score[score > 0.9].mean()) < 0.03


def test_label_source_and_id_are_no_inputs(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    one = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    blind = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(blind, model).collect()} == one


def test_texts_of_noise_are_rejected_and_others_stay(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    assert 0 < model.threshold <= 0.5
    rng = np.random.default_rng(3)
    noise = [(i, "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200))) for i in range(20)]
    found = langid.identify(spark.createDataFrame(noise, "doc_id int, text string"), model).collect()
    clean = langid.identify(docs, model)
    assert clean.where("rejected").count() < 0.02 * docs.count()
    assert np.mean([r["score"] for r in found]) < np.mean([r["score"] for r in clean.select("score").collect()])


def test_cases(spark):
    words = {"en": "the house and the river with many words", "fr": "la maison et la rivière avec des mots", "de": "das Haus und der Fluss mit vielen Wörtern"}
    rows = [(i, f"{t} {i % 7} {t}", x) for k, (x, t) in enumerate(words.items()) for i in range(100 * k, 100 * k + 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, " 12 ,.- 3", None), (1003, "é", None), (1004, "the river " * 100_000, None), (None, words["fr"], "fr"), (1, words["de"], "de"), (1, words["en"], "en")]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows + odd + odd[-1:]], "doc_id int, text string, lang string, source string, score double").repartition(4)
    found = langid.held_out_predictions(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == docs.count()
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[1000] == got[1001] == got[1002] == [("und", 0.0)]
    assert got[1003][0][0] in words and got[1004][0][0] == "en" and got[None][0][0] == "fr"
    assert all(v[0][0] == x for i, _, x in rows if i != 1 for v in [got[i]])
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()}
    assert langid.held_out_predictions(docs.limit(0)).count() == 0
    blank = docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false")
    assert langid.keep_identified(blank).count() == 0
    untaught = langid.held_out_predictions(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


@pytest.mark.parametrize("n", [1, 50])
def test_sample_is_bounded_when_ids_repeat(spark, n):
    docs = spark.createDataFrame([(i % 3, f"words of row {i}", "en") for i in range(300)], "doc_id int, text string, lang string")
    seen = []
    fit, langid.fit = langid.fit, lambda rows: seen.append(rows) or fit(rows)
    try:
        langid.train(docs, per_lang=n)
    finally:
        langid.fit = fit
    assert len(seen[0]) <= min(n, 3)
