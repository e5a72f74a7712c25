import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathlume.llm.tokenizer import DEFAULT_VOCABULARY, BacktrackingEncoder, Decoder, Vocabulary, encode_column, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    vocabulary = Vocabulary.load()
    reference = Tokenizer.from_file(DEFAULT_VOCABULARY)
    reference.encode_special_tokens = True
    return BacktrackingEncoder(vocabulary), Decoder(vocabulary), lambda s: reference.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "\n\n", "a" * 3000, "ab" * 2000, " " * 999, "日本語" * 500, "=" * 777 + "x", "<|endoftext|>", "don't we'll I'VE", "​﻿", "é é", "😀👩‍👩‍👧", "0123456789 12 345", "\t\tx  y \r\n z", "ﷺ\u0000\u001f", "Ünïcödé ÄÖÜ"]


def test_ids_are_those_of_merging_by_rank(tools):
    encoder, decoder, reference = tools
    rng = random.Random(4)
    alphabet = "etaoin shrdlu" * 3 + "ABC0'’éßяд日の​\n\t—😀.,-_<|>"
    for text in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]:
        ids = encoder.encode(text)
        assert ids == reference(text) and decoder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_of_any_text(tools, text):
    encoder, decoder, reference = tools
    ids = encoder.encode(text)
    assert decoder.decode(ids) == text and ids == reference(text)


def test_column_has_empty_lists_for_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "hello hello", 7), (3, "hello hello", 7), (4, "x" * 200_000, 7)], "doc_id long, text string, n int")
    got = [(r["doc_id"], r["ids"], r["n"]) for r in encode_column(df, "text").collect()]
    assert got[0][1] == got[1][1] == [] and got[2] == got[3] and got[2][1] == [31373, 23748] and len(got[4][1]) > 1000
    assert [r["n_tokens"] for r in token_counts(df, "text").collect()] == [len(g[1]) for g in got]
    assert encode_column(df.limit(0), "text").count() == 0
    assert dict(encode_column(df, "text").dtypes)["ids"] == "array<int>"
    with pytest.raises(ValueError):
        encode_column(df, "text", ids="n")
    with pytest.raises(FileNotFoundError):
        encode_column(df, "text", path="/nowhere.json")
