import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metrolith.llm.tokens import PATTERN, VOCABULARY, bpe, decode_documents, encode_documents, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    k = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe().ranks, special_tokens={})
    return lambda s: (t.encode(s, add_special_tokens=False).ids, k.encode_ordinary(s))


CASES = ["a", " ", "\n\n  x", "don't DON'T", "<|endoftext|>", "日本語のテキスト", "naïve café 👍🏽", "x" * 5000, "ab" * 3000, " " * 999, "1234567890" * 50, "\x00\ufffd\u200d", "éè" * 700, "a\r\nb\tc"]


@pytest.mark.parametrize("text", CASES)
def test_same_as_the_libraries(text, other):
    ids = bpe().encode(text)
    assert (ids, ids) == other(text)
    assert bpe().decode(ids) == text
    assert bpe().count(text) == len(ids)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_random_texts(text):
    import tiktoken

    k = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe().ranks, special_tokens={})
    ids = bpe().encode(text)
    assert ids == k.encode_ordinary(text) and bpe().decode(ids) == text


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "hello world"), (4, "hello world"), (None, "x"), (5, "y" * 300_000)]
    df = spark.createDataFrame([(i, t, [1], 7) for i, t in rows], "doc_id long, text string, ids array<int>, tokens int")
    enc = encode_documents(df)
    got = sorted((r.doc_id or 0, tuple(r.ids)) for r in enc.collect())
    assert got == sorted((i or 0, tuple(bpe().encode(t))) for i, t in rows)
    assert {r.doc_id: r.text for r in decode_documents(enc).collect()}[5] == "y" * 300_000
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()}[1] == 0
    assert encode_documents(df.limit(0)).count() == 0
