"""Ids of merge and unigram model files against the library's own encoder."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb2

from quire.llm import sentencepiece_scan
from quire.llm.sentencepiece_scan import Model, encode, normalised

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["The internationalization documents", "", " ", "a   b\t\tc\n\n  d     e", "é 漢字 😀 [[a]] | <s> \\l ▁ " * 40, "=" * 700, "ab" * 400, "漢字の文書処理" * 100, " " * 500 + "x", "0" * 333 + "anan" * 90]


def library(sp, texts):
    return Counter(np.array(sp.encode(t), "<u2").tobytes() for t in texts)


def test_merges_same_as_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"))
    want = library(sp, [r.text or "" for r in docs.collect()])
    assert Counter(bytes(r.ids) for r in encode(docs).collect()) == want
    for chunk in (23, 1000):
        assert Counter(bytes(r.ids) for r in encode(docs, giant=60, chunk=chunk).collect()) == want


def unigram_file(path: str, pieces: dict[str, float]) -> None:
    """A model file with the given pieces and scores, and a piece for every byte."""
    model = pb2.ModelProto()
    kinds = pb2.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0.0, kinds.UNKNOWN), ("<s>", 0.0, kinds.CONTROL), ("</s>", 0.0, kinds.CONTROL), *((f"<0x{b:02X}>", 0.0, kinds.BYTE) for b in range(256)), *((p, x, kinds.NORMAL) for p, x in pieces.items())]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = "identity", True, False, True
    with open(path, "wb") as file:
        file.write(model.SerializeToString())


def test_unigram_same_as_library(spark, tmp_path, monkeypatch):
    """Scores are drawn, not trained; giant documents go through blocks of chunks."""
    monkeypatch.setattr(sentencepiece_scan, "BLOCK", 3)
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeilnorst") for _ in range(r.randrange(2, 6))) for _ in range(120)]
    texts = [" ".join(r.choice(stems) + r.choice(["", "ing", "ed", "s"]) for _ in range(40)) for _ in range(150)] + ["xyz" * 300, "ab" * 3000, " ".join(r.choice(stems) for _ in range(20000))]
    pieces = {*"abcdeilnorst", "▁", "ing", "ed", "▁a", *stems[:60], *(f"▁{x}" for x in stems[40:]), *(x[:3] for x in stems)}
    path = str(tmp_path / "uni.model")
    unigram_file(path, {p: -r.uniform(2, 4) - 1.1 * len(p) ** 0.5 for p in sorted(pieces)})
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = Model(path)
    assert not m.merges and any(x != round(x) for x in m.scores.values())
    want = library(sp, texts)
    assert Counter(m.encode(normalised(t)) for t in texts) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for giant, chunk in ((60, 50), (60000, 20000)):
        assert Counter(bytes(x.ids) for x in encode(docs, "uni.model", str(tmp_path), giant=giant, chunk=chunk).collect()) == want
