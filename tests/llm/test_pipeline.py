from collections import Counter
from hashlib import sha256

import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrain.llm import common, langid, mixing
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "mixing", "BPE"]
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialise(stage(spark, now, SF), "test")
        seen[name] = now
        if name != "BPE":
            assert now.columns == docs.columns
    kept = {r["doc_id"] for r in seen["language ID"].collect()}
    found = {r["doc_id"]: r["rejected"] for r in langid.identify(docs, langid.train(docs)).collect()}
    assert kept == {i for i, bad in found.items() if not bad} and len(kept) > 0.97 * len(rows)
    want = brute({i: rows[i] for i in kept})
    left = {r["doc_id"] for r in seen["n-gram Jaccard join"].collect()}
    assert left == {i for i, (_, group, *_) in want.items() if group == i}
    rates = {r["doc_id"]: r["copies"] for r in mixing.rates(seen["n-gram Jaccard join"], common.table(spark, SF, "labels")).collect()}
    mixed = Counter(r["doc_id"] for r in seen["mixing"].collect())
    assert mixed == Counter({i: n for i, n in rates.items() if n})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = seen["BPE"].toPandas()
    assert len(got) == sum(mixed.values())
    for i, n, ids, decoded in got.drop_duplicates().itertuples(index=False):
        own = library.encode(rows[i], add_special_tokens=False).ids
        assert (n, ids) == (len(own), sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert decoded == sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    again = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "n_tokens"]
    pd.testing.assert_frame_equal(again.sort_values(key).reset_index(drop=True), got.sort_values(key).reset_index(drop=True))
