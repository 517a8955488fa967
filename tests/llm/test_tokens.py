"""Ids against the vocabulary's own library, texts against a round trip."""

import random
from pathlib import Path

import pytest

from judgelake.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.DEFAULT_VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    made = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)
    made.encode_special_tokens = True
    return made


def test_against_library(library):
    rng = random.Random(5)
    letters = "ab AB \t\n\r\x0b\x1c\x85\xa0 　é中😀'sdt12²Ⅷ<|endoftext|>́\xad_-."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, " " * 300, "ab" * 2000, "don't we'll  it's"]
    model = tokens.MergeReplay(Path(tokens.DEFAULT_VOCABULARY).read_bytes())
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "  "), (4, "hello <|endoftext|>"), (4, "hello <|endoftext|>"), (5, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id bigint, text string, ids array<int>")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_documents(df).collect()]
    assert sorted(got) == sorted((i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    assert tokens.encode_documents(df.limit(0)).count() == 0
