"""Packing ids of texts that hold added tokens, against the tokenizer as its file has it."""

import numpy as np
from tokenizers import Tokenizer

from riskrank.llm import packing, queries


def test_added_tokens_are_coded_as_the_library_does():
    exact = Tokenizer.from_file(queries.WORD_VOCABULARY)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y z.", "<|EndOfText|>abc d", "plain text.", "a\x1cb <|endoftext|>", ""]
    got = packing.Coder(queries.WORD_VOCABULARY).all_ids(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [
        exact.encode(text, add_special_tokens=False).ids for text in texts]
