import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sangloc.llm import bpe
from sangloc.llm.queries import op9_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONTENT = bpe.read_ranks(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_same_ids_as_the_library_and_back(text):
    packed = bpe.encoder(CONTENT, public_tokenizers.PATTERN).encode([text])[0]
    assert ids(packed) == OTHER.encode_ordinary(text)
    assert bpe.decode_ids(packed, bpe.tokens_by_id(CONTENT)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="'sStdmrelv 1²?\n\t\x1c\x85\xa0éß_", max_size=40))
def test_same_ids_on_the_letters_that_decide_the_cut(text):
    assert ids(bpe.encoder(CONTENT, public_tokenizers.PATTERN).encode([text])[0]) == OTHER.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, " " * 3000, "é" * 999, "thethe" * 700 + "\n" * 70, "🙂" * 500])
def test_long_pieces(text):
    assert ids(bpe.encoder(CONTENT, public_tokenizers.PATTERN).encode([text])[0]) == OTHER.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 600)
    own = bpe.Encoder(CONTENT, public_tokenizers.PATTERN)
    for text in ["one two three four five", "six seven eight", "one nine"]:
        assert ids(own.encode([text])[0]) == OTHER.encode_ordinary(text)


def test_nulls_empty_repeated_and_clashing_columns(spark):
    rows = [(1, "the cat", "a"), (1, "the cat", "a"), (2, None, None), (3, "", "b"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert (by[2].n_tokens, by[2].ids_sha256, by[2].decoded_sha256) == (0, empty, empty)
    assert (by[3].n_tokens, by[3].decoded_sha256) == (0, empty)
    assert by[1].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op9_byte_bpe(spark, folder).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        want = OTHER.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
