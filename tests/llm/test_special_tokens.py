"""Texts that have a special token's literal are encoded as the tokenizer does it."""

from __future__ import annotations

from gridquill.llm import wavelet
from tests.llm.fixtures import odd_docs, odd_texts
from tests.llm.test_media_and_files import TOKENIZER, expected_tokens


def test_special_tokens(spark):
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|endoftext|>Y é <|startoftext|>", "<|endoftext|>", "<|endof", "text|> c", "<|startoftext|><|endoftext|> <|EndOfText|>", "plain"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_texts()
    found = wavelet.token_id_shards(odd_docs(spark, rows), TOKENIZER)
    assert sorted(map(tuple, found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == sorted(expected_tokens(rows), key=repr)
