"""Operators 1 and 2 against the library that owns the vocabulary file."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.bpe import Encoder, decode, decode_ids, encode
from millrace.llm.bpe_vocab import Vocabulary
from millrace.llm.queries import vocab_path
from millrace.llm.token_count import _Counter, token_counts

from .helpers import ODD, documents

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.load(vocab_path())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocab_path())
    t.no_truncation()
    t.no_padding()
    return t


PIECES = [*"abcXYZ 019'.,!\n\t\r éß漢🎉\x00", "the ", "'ll", "<|endoftext|>", "  "]
TEXT = st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(vocab, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = Encoder(vocab, 1000).texts([text])[0]
    assert got == want
    assert decode_ids(got, vocab) == library.decode(want, skip_special_tokens=False)
    assert _Counter(vocab, 1000).text(text) == len(want)


def test_odd_rows(spark, library):
    docs = documents(spark, ODD)
    got = encode(docs, vocab_path(), decode_too=True).collect()
    assert len(got) == len(ODD)
    want = sorted((library.encode(t or "", add_special_tokens=False).ids, t or "") for _, t in ODD)
    assert sorted((r["ids"], r["decoded"]) for r in got) == want
    counts = token_counts(docs, vocab_path()).collect()
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts) == sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids), len(library.encode(t or "", add_special_tokens=False).ids) > 1024) for _, t in ODD)


def test_decode_alone_and_empty_table(spark):
    docs = documents(spark, ODD)
    coded = encode(docs, vocab_path())
    back = decode(coded.withColumn("ids", F.when(F.size("ids") > 0, F.col("ids"))), vocab_path())
    assert sorted(r["decoded"] for r in back.collect()) == sorted(t or "" for _, t in ODD)
    assert encode(docs.limit(0), vocab_path()).count() == 0
    assert token_counts(docs.limit(0), vocab_path()).count() == 0
