import random
import time
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrain.llm import bpe, common

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_equals_the_library_on_the_table(spark, library):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    assert got == {i: want(library, t) for i, t in rows.items()}


POOLS = [
    "abcXYZ  '", "'s't're've'm'll'd ’s", "\t\n\r\x0b\x0c\x85\xa0  ​  　﻿\x1c\x1f\x00", "éüßņ̃̈ḈÇ", "你好ひカ한각ㄱㅏ", "😀👍🏽‍👩🇩🇪", "0123½²٣Ⅳ",
    "!?.,<>|\\/@#$%^&*()_+-=~`[]{}\"", "ΣσςİıǅﬁﷺΩ", "՘ᲉꟋꟜ\U00010d50\U00016ea0\U000323b0\U0010ffff",
]


def test_equals_the_library_on_odd_texts(library):
    rng = random.Random(1)
    known, decoded = bpe._worker(PATH)
    for _ in range(4000):
        parts = ["".join(rng.choices(rng.choice(POOLS), k=rng.randint(1, 8))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endof", "</w>"]))
        text = "".join(parts)
        assert bpe.digest(text, known, decoded) == want(library, text), text


def test_cases(spark, library):
    texts = [None, "", " \n\t", "a" * 100_000, "one two " * 50_000, "twice", "twice"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    assert got == {i: want(library, t) for i, t in enumerate(texts)}
    both = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    for r in both:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_stale_entries_are_skipped(library):
    """Repeated letters push pairs that merge away before their turn."""
    b = bpe.Bpe(PATH)
    for text in ("aaaaaaa", "lolololol", "ninininin", "hahahaha", "ab" * 40):
        assert b.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_words_together_equal_the_library(library, monkeypatch):
    """Words of many texts are merged together, also where dictionaries start anew and chunks end within the texts."""
    monkeypatch.setattr(bpe, "KEEP", 500)
    monkeypatch.setattr(bpe, "CHUNK", 2_000)
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    rng = random.Random(2)
    texts = ["", " ", "lolololol " * 300, " ".join("na" * i for i in range(1, 40)), " ".join("é" * i + "'s" * i for i in range(1, 40)), "<b>a</b> <|endoftext|>x<|startoftext|> <|endof"]
    for _ in range(3000):
        texts.append("".join("".join(rng.choices(rng.choice(POOLS + [" eanotlh"] * 3), k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))))
    b = bpe.Bpe(PATH)
    known, decoded = bpe._Known(b), {str(i): s for i, s in b.names.items()}
    assert list(bpe.digest_all(texts, known, decoded)) == [want(library, t) for t in texts]
    assert len(known) < 2_500 and len(known.pieces) < 2_500


def test_many_different_words_cost_little():
    """Together they take under half of the CPU time that they take one by one."""
    rng = random.Random(3)
    text = " ".join({"".join(rng.choices(["en", "er", "th", "a", "ó", "sch", "ing", "o"], k=rng.randint(3, 6))) for _ in range(40_000)})
    b = bpe.Bpe(PATH)
    began = time.process_time()
    one_by_one = b.encode(text)
    between = time.process_time()
    known = bpe._Known(b)
    known.learn(set(bpe.Bpe.split(text)))
    together = time.process_time() - between
    assert " ".join(known[w] for w in text.split()) == " ".join(map(str, one_by_one))
    assert together < (between - began) / 2
