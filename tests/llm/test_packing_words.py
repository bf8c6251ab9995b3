"""Packing: words are parted, remembered and encoded many at a time, with the ids of the library."""

import random

import numpy as np
from quire.llm import packing as pk

CHARS = [*"abzABZ019 \t\n'.,-_<|>!?\x00~", "é", "É", "×", "÷", "ß", "Å", "ſ", "İ", "́", "̸", "ª", "½", "日", "Σ", "'s", "'re ", "<|endoftext|>", "<|EndOfText|>", " ", "ﬁ", " "]


class Counted:
    """A tokenizer that counts the texts it encodes in batches."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_texts_of_odd_characters(monkeypatch):
    monkeypatch.setattr(pk, "JOINED", 7)
    monkeypatch.setattr(pk, "MEMO_WORDS", 500)
    encoder, r = pk.Encoder(pk.tokenizer_path("word_bpe_49k.json")), random.Random(5)
    for _ in range(60):
        texts = ["".join(r.choices(CHARS, k=r.randrange(60))) for _ in range(40)] + [""]
        words = encoder.split([t.encode() for t in texts])
        ids = encoder.words({x for own in words for x in own})
        for text, own in zip(texts, words, strict=True):
            found = np.frombuffer(b"".join(map(ids.__getitem__, own)), "<u4").tolist()
            assert found == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder.split([]) == []


def test_the_library_gets_few_texts():
    encoder = pk.Encoder(pk.tokenizer_path("word_bpe_49k.json"))
    whole, encoder.tokenizer = pk.Encoder(pk.tokenizer_path("word_bpe_49k.json")).whole, (counted := Counted(encoder.tokenizer))
    some = ["".join(random.Random(i).choices("abcdeé", k=8)) for i in range(2000)]
    once = {x.encode() for x in some}
    ids = encoder.words(once)
    assert counted.texts <= 2 * (2000 // pk.JOINED + 1)
    assert all(ids[x] == whole(x) for x in once)
    before = counted.texts
    encoder.words({x + m for x in once for m in (b"", b",", b".")})
    encoder.words({x + m for x in once for m in (b"", b",", b".")})
    assert counted.texts <= before + 2  # the two marks
