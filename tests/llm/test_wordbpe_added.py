"""Texts with the tokenizer's added tokens, against the library."""

import numpy as np
import public_tokenizers
from barloom.llm.wordbpe import WordBpe


def test_added_tokens_equal_the_library():
    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "é 漢<|startoftext|><|endoftext|>\n!", "x\x1c<|endoftext|>", "plain."]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    assert list(bpe.encode(texts)) == want and 49407 in np.frombuffer(want[0], "<u4")
