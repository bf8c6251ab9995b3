"""The local search against all allowed steps, levels of groups, and ids of odd words against the library."""

from itertools import combinations

import numpy as np
import pytest
from quire.llm import packing as pk
from quire.llm.common import tokenizer_path

SIZES = {
    "uniform": lambda r, n: r.integers(1, 101, n),
    "thirds": lambda r, n: r.integers(29, 37, n),
    "over half": lambda r, n: r.integers(51, 90, n),
    "tiny": lambda r, n: r.integers(1, 4, n),
}


@pytest.mark.parametrize("kind", SIZES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_step_is_left(kind, seed):
    lengths = SIZES[kind](np.random.default_rng(seed), 60).astype(np.int64)
    start = pk.best_fit(lengths, 100)
    bins = pk.local_search(lengths, start, 100)
    fill = np.bincount(bins, lengths, max(start.max(), bins.max()) + 1).astype(int)
    assert fill.max() <= 100 and fill.sum() == lengths.sum()
    assert (fill**2).sum() >= (np.bincount(start, lengths) ** 2).sum()
    assert (fill > 0).sum() <= start.max() + 1
    for b in np.flatnonzero((fill > 0) & (fill < 100)):
        own = lengths[bins == b].tolist()
        amounts = own + [x + y for x, y in combinations(own, 2)]
        for o in np.flatnonzero((fill >= fill[b]) & (fill < 100)):
            if o != b:
                others = [0, *lengths[bins == o].tolist()]
                assert not any(0 < a - x <= 100 - fill[o] for a in amounts for x in others if x or a in own)


def test_levels_lose_nothing_and_fill_well(spark):
    r = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(1, 90, 3000))]
    out = pk.pack(spark.createDataFrame(rows, pk.PIECE), 100, group=200).collect()
    assert sorted(x.doc_id for x in out) == list(range(3000))
    ends: dict[int, list] = {}
    for x in out:
        ends.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for x in ends.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 100
    bound = -(-sum(x[3] for x in rows) // 100)
    assert bound <= len(ends) <= 1.03 * bound  # groups of 200 alone need 1.037 times the bound


def test_pieces_that_no_level_can_join(spark):
    out = pk.pack(spark.createDataFrame([(i, 0, 0, 60, 0) for i in range(300)], pk.PIECE), 100, group=50).collect()
    assert len({x.sequence_id for x in out}) == len(out) == 300 and all(x.offset == 0 for x in out)


def test_ids_of_odd_words(spark, monkeypatch):
    monkeypatch.setattr(pk, "MEMO_WORDS", 20)
    texts = [
        "it's I'm \"Don't!\" 'S x'. é. É, é. Å,, 12a. _x_. o'clock's. …. a…. Σ. ΑΣ, İ. ﬁ. 3. ³. Ⅷ, ½. b, ($5)(a)'s) --- 's' CAN'T. x̀́!? 日本。 日本. _ -a- a_b_ ǅ.",
        "a.'s b,'t q'll. z'", "THE&&& the*** thE!! | a b. c d,", " ".join(f"W{i}." for i in range(200)), "x" * 3000 + " " + "," * 3000,
        "<|endoftext|>", "a<|endoftext|>b. <|ENDOFTEXT|> <|EndOfText|>, x<|startoftext|><|endoftext|>... <|endoftext|", "é<|endoftext|>é. <|endoftext|>'s <|end oftext|> <|endoftext|>!?",
    ]
    encoder = pk.Encoder(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):
        for text in texts:
            words = text.encode().split()
            ids = encoder.words(set(words))
            found = np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4").tolist()
            assert found == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_of_another_form_are_encoded_whole(spark, tmp_path):
    import json
    import zlib

    said = json.loads(pk.Encoder(tokenizer_path("word_bpe_49k.json")).tokenizer.to_str())
    said["normalizer"]["normalizers"].pop()  # words keep their capitals
    (tmp_path / "other.json").write_text(json.dumps(said))
    other = pk.Encoder(str(tmp_path / "other.json"))
    assert not other.by_words and pk.Encoder(tokenizer_path("word_bpe_49k.json")).by_words
    texts = ["It's a Test, IS it?", "", "ABC<|endoftext|> x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.length, r.ids_crc32) for r in pk.token_pieces(rows, str(tmp_path / "other.json"), 2048).collect()}
    for i, text in enumerate(texts):
        ids = [*other.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert found[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
