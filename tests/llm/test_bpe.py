import random

import pytest
from lexiframe.llm import bpe
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_against_the_public_library(public):
    r = random.Random(5)
    alphabet = "abcdefgh  \n\tThe123456,.!?éüñ中文字日本語ไทย한글हिन्दी🙂👨‍👩‍👧​"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(r.choice("aeinst") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 200)] + [" " * n for n in range(1, 200)] + ["=-" * 90, "<|endoftext|> is text", "it's we'll I'D"]
    got = bpe.load().encode_batch(texts)
    assert got == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert all(bpe.round_trip(i) == t for i, t in zip(got[:300], texts[:300]))


def test_frame(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "hi", 9), (2, None, 9), (3, "", 9), (1, "hi", 9), (None, "x", 9), (4, long, 9)], "doc_id bigint, text string, ids int")
    rows = bpe.encode(df).collect()
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []] and sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert bpe.count_ids(df).where(F.col("doc_id") == 4).first().n_ids == len(rows[-1].ids)
    assert bpe.encode(df.limit(0)).count() == 0


def test_small_memory(monkeypatch):
    b = bpe.load()
    want = b.encode_batch(["alpha beta gamma", "delta beta"])
    monkeypatch.setattr(bpe, "WORD_MEMORY", 2)
    assert b.encode_batch(["alpha beta gamma", "delta beta"]) == want
