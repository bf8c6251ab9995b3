"""Packing: a task holds the words of a bounded piece of its batch."""

from quire.llm import packing


def test_words_of_few_bytes_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(50)], "doc_id long, text string").coalesce(1)
    run = lambda: sorted(map(tuple, packing.token_pieces(docs, packing.tokenizer_path("word_bpe_49k.json"), 64).collect()))
    whole = run()
    assert packing.TEXT_BYTES <= 2 << 20
    monkeypatch.setattr(packing, "TEXT_BYTES", 1000)
    assert run() == whole and len(whole) > 50
