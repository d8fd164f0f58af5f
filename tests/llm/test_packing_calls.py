"""How often the word coder calls its tokenizer."""

import random
import re

from tokenizers import Tokenizer

from riskrank.llm import packing, queries


def test_odd_words_are_coded_in_few_calls():
    coder, library = packing.Coder(queries.WORD_VOCABULARY), Tokenizer.from_file(queries.WORD_VOCABULARY)
    draw = random.Random(3)
    words = ["".join(draw.choices("ab9|-'é.(ß", k=6)) for _ in range(2_000)] + ["|", "||", "x-|", "Ab", "don't"]
    texts = [" ".join(words[at:at + 50]) for at in range(0, len(words), 50)]
    calls, one = [], coder._coded
    coder._coded = lambda text: calls.append(text) or one(text)
    for text, ids in zip(texts, coder.all_ids(texts)):
        assert memoryview(ids).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(packing.BAR in c for c in calls) and len({w for w in words if not re.search(r"\|", w)}) > 500
