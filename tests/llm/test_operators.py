"""The training-data operators against brute force, round trips and SQL, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import queries
from quire.llm.chat_format import example_texts, expand, format_conversations, read_back
from quire.llm.embedding_dedup import near_duplicates
from quire.llm.license_scan import scan_licenses
from quire.llm.line_dedup import PerfectHash, dedup_lines, lost_lines
from quire.llm.packing import best_fit_packing
from quire.llm.quality_classifier import classify_quality, trusted_ids
from quire.llm.quality_rules import apply_rules
from quire.llm.sentencepiece_scan import decode, encode
from quire.llm.token_counts import count_tokens, read_token_files, separator_scan

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c\na b c\n\nthe same long line here", "en"), (2, None, None), (3, "", "en"), (4, " \t\n ", "de"), (None, "the same long line here", "en"), (5, "The same long line HERE  \nown", "en"), (5, "The same long line HERE  \nown", "en"), (6, "é 漢字 😀 [[a]] | <b> \\l " * 300, "en")]
SCHEMA = "doc_id long, text string, lang string, n long, lost string, row string, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE[name])
    names = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in names]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def test_rules_same_as_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in apply_rules(docs).collect()))
        want = []
        for r in docs.select("text").collect():
            t = r.text or ""
            w = WORD.findall(t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                dup += bool(WORD.search(line)) and line in seen
                seen.add(line)
            at = defaultdict(list)
            for i in range(len(w) - 4):
                at[tuple(w[i : i + 5])].append(i)
            hit = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 5)}
            want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
        assert got == sorted(want)


def test_rules_keep_clean_text_and_reject_noise(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aeiou") + r.choice("lnrst") for _ in range(r.randrange(1, 4))) for _ in range(200)]
    rows = [(i, " ".join(r.choice(words) for _ in range(120)), "en") for i in range(80)]
    rows.append((100, " ".join("".join(chr(r.randrange(33, 1000)) for _ in range(8)) for _ in range(120)), "en"))
    kept = {x.doc_id: x.kept for x in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(100) and all(kept.values())


def test_classifier_edge_cases(spark, odd, none):
    trusted = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    out = classify_quality(odd, trusted).collect()
    assert len(out) == len(ODD)
    assert all(r.kept == (r.n_words > 0 and (r.limit is None or r.loss <= r.limit)) for r in out)
    assert all(r.kept for r in out if r.doc_id == 1)
    assert all(r.kept == (r.n_words > 0) for r in classify_quality(odd, trusted.limit(0)).collect())
    assert classify_quality(none, trusted).count() == 0 and apply_rules(none).count() == 0


def test_classifier_on_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = trusted_ids(labels)
    train = good.filter("doc_id % 2 = 0")
    scored = classify_quality(docs, train).join(good.filter("doc_id % 2 = 1"), "doc_id", "left_semi")
    kept = [r.kept for r in scored.collect()]
    assert sum(kept) >= 0.98 * len(kept)


def test_line_dedup_edge_cases(spark, odd, none):
    out = {(r.doc_id, r.kept_text): (r.n_lines, r.n_dropped) for r in dedup_lines(odd, shard_keys=2).collect()}
    assert out[1, "a b c\na b c\n\nthe same long line here"] == (4, 0)
    assert out[None, "the same long line here"] == (1, 0) and out[5, "own"] == (2, 1)
    assert out[2, ""] == (1, 0) and out[3, ""] == (1, 0)
    assert dedup_lines(none).count() == 0
    assert dedup_lines(odd, carry=True).select("original.*").exceptAll(odd).count() == 0


def test_lost_lines_in_pieces(spark):
    """Shards in many pieces, one line with a third of all probes, equal first halves of hashes, against brute force."""
    rng = np.random.default_rng(2)
    rows = [(int(d), int(k) % 211 - 100, int(k)) for d, k in zip(rng.integers(0, 400, 3000), rng.integers(0, 1500, 3000), strict=True)] + [(int(d), 7, 7) for d in rng.permutation(1500)]
    held = {}
    for d, a, b in rows:
        held.setdefault((a, b), set()).add(d)
    want = sorted((d, a, b) for d, a, b in rows if len(held[a, b]) > 1 and d != min(held[a, b]))
    lines = spark.createDataFrame(rows, "doc_id long, a long, b long")
    for shard_keys, probes in ((40, 25), (100_000, 200), (40, 400_000)):
        assert sorted(map(tuple, lost_lines(lines, shard_keys, probes).collect())) == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    made = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(made.places(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.of(keys[:0]).places(keys[:3]).tolist() == [-1, -1, -1]


def test_embeddings_same_as_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in table], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = np.argsort([r.vec_id for r in table])
    rank = {int(i): k for k, i in enumerate(order)}
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        if a != b:
            lo, hi = (a, b) if rank[a] < rank[b] else (b, a)
            root[hi] = lo
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op4_embedding_dedup"](spark, "/root/testdata/sf0.01").collect()}
    want = {r.vec_id: (int(near[i].sum()) - 1, table[find(i)].vec_id, find(i) == i) for i, r in enumerate(table)}
    assert got.keys() == want.keys()
    assert sum(got[k][0] for k in got) >= 0.9 * sum(want[k][0] for k in want) and all(got[k][0] <= want[k][0] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_embeddings_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 5), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (8, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [0.999, 0.01], 1)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[9] == (2, 1, False)
    assert all(out[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8)) and out[None][1:] == (None, None)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_licences(spark, none):
    rows = [(1, "Text.\nThis work is licensed under the GNU General Public License, version 3.\nMore."), (2, "Released under the MIT License."), (3, "The pub lost its license last year."), (None, "Licensed under CC BY 4.0."), (4, None), (5, ""), (2, "Released under the MIT License."), (6, "Licensed under the Apache License, Version 2.0.")]
    out = scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family) for r in out if r.confirmed) == [(0, 0, "cc-by"), (1, 0, "gpl-3.0"), (2, 0, "mit"), (2, 0, "mit"), (6, 0, "apache-2.0")]
    assert scan_licenses(none).count() == 0


def test_token_counts(spark, odd, none):
    import tiktoken  # noqa: F401

    from quire.llm.token_counts import encoder

    enc = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for block in (7, 1 << 18):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in count_tokens(odd, block_ids=block).collect())
        assert got == sorted((d is None, d or 0, len(enc.encode_ordinary(t or ""))) for d, t, _ in ODD)
    assert count_tokens(none).count() == 0


def test_separator_scan_stitches(spark):
    r = random.Random(4)
    ids = [r.choice([1, 2, 9]) for _ in range(200)]
    ids[60:110] = [1] * 50
    flat = np.array(ids, "<u2")
    blocks = [(0, i, flat[7 * i : 7 * i + 7].tobytes()) for i in range(math.ceil(len(ids) / 7))] + [(1, 0, None), (1, 1, b"")]
    got = [(x.start, x.n_tokens, x.closed) for x in separator_scan(spark.createDataFrame(blocks, "file long, block long, ids binary"), separator=9).filter("file = 0").orderBy("ordinal").collect()]
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 9:
            want.append((start, i - start, True))
            start = i + 1
    if start < len(ids):
        want.append((start, len(ids) - start, False))
    assert got == want


def test_sentencepiece_chunks_and_round_trip(spark, odd, none):
    docs = odd.select("doc_id", "text")
    whole = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in encode(docs).collect())
    for chunk in (50, 333):
        assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in encode(docs, giant=60, chunk=chunk).collect()) == whole
    assert sorted((r.doc_id or 0, r.text) for r in decode(encode(docs)).collect()) == sorted((d or 0, t or "") for d, t, _ in ODD)
    assert encode(none).count() == 0


def test_chat_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|user|>[INST]\\l"), (1, 2, "assistant", "</s>a"), (1, 3, None, None), (1, 4, "assistant", "b"), (1, 5, "user", "last"), (2, 0, "user", "q"), (None, None, "assistant", "x")]
    out = format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int"))
    spelt = example_texts(out).collect()
    texts = {(r.conv_id, r.example): (r.text[: r.mask_start], r.text[r.mask_start : r.mask_start + r.mask_chars]) if r.mask_start is not None else (r.text, None) for r in spelt}
    assert all(r.text == texts[r.conv_id, r.example][0] + texts[r.conv_id, r.example][1] + "</s>" for r in spelt if r.mask_start is not None)
    rows_of = {(r.conv_id, r.example): r for r in expand(out).collect()}
    assert rows_of.keys() == texts.keys() and all(len(r.text) == rows_of[r.conv_id, r.example].chars and rows_of[r.conv_id, r.example].completion == texts[r.conv_id, r.example][1] for r in spelt)
    assert texts[1, 1][0].endswith("<|assistant|>") and texts[1, 1][1] == "\\l/s>a"
    assert texts[1, 2][0].startswith(texts[1, 1][0] + texts[1, 1][1]) and texts[1, 2][1] == "b"
    assert texts[1, 3][1] is None and texts[2, 1][1] is None and texts[None, 1] == ("<|assistant|>", "x")
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_flat_token_files(spark, tmp_path):
    """Files of ids without an index, cut in blocks that documents span, whole and by ranges; an empty file, and one that ends open."""
    r = np.random.default_rng(3)
    want = []
    for name, docs, tail in (("a.bin", [5, 0, 40, 1, 300], 0), ("b.bin", [7], 3), ("c.bin", [], 0)):
        ids = np.concatenate([*(x for n in docs for x in (r.integers(0, 50000, n), [50256])), r.integers(0, 50000, tail)]).astype("<u2") if docs else np.zeros(0, "<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        starts = np.cumsum([0, *(n + 1 for n in docs)]).tolist()
        want += [(int(s), n, True) for s, n in zip(starts, docs, strict=False)] + [(starts[-1], tail, False)] * bool(tail)
    for whole in (1 << 20, 0):
        out = separator_scan(read_token_files(spark, f"file://{tmp_path}", block_ids=16, whole=whole))
        assert sorted((x.start, x.n_tokens, x.closed) for x in out.collect()) == sorted(want)


def test_chat_ties_repeats_and_long_texts(spark):
    """Equal turn numbers go by role and text, repeated rows are turns, and a mask moved by one character would show."""
    rows = [(1, 1, "user", "q"), (1, 1, "assistant", "z"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "system", "s"), (2, 1, "assistant", "<|x|>\\[é]" * 20000), (2, 2, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in read_back(expand(format_conversations(table))).collect()}
    hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (5, 3, hashed("aaz"))
    assert found[1].turns_sha256 == hashed("system\ns\nassistant\na\nassistant\na\nassistant\nz\nuser\nq\n")
    assert (found[2].n_turns, found[2].loss_chars, found[2].loss_sha256) == (2, 180000, hashed("<|x|>\\[é]" * 20000))
    wrong = expand(format_conversations(table)).withColumn("completion", F.substr("conversation", (F.col("mask_start") + 2).cast("int"), F.col("mask_chars").cast("int")))
    assert {r.conv_id: r.loss_sha256 for r in read_back(wrong).collect()}[2] != found[2].loss_sha256


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for table in (odd.select("doc_id", "text"), docs):
        out = best_fit_packing(table).collect()
        want = []
        for d, t in table.collect():
            ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(d or 0, i, 2048 * i, len(ids[2048 * i : 2048 * i + 2048]), zlib.crc32(ids[2048 * i : 2048 * i + 2048].tobytes())) for i in range(math.ceil(len(ids) / 2048))]
        assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
        bins = defaultdict(list)
        for r in out:
            bins[r.sequence_id].append((r.offset, r.length))
        for x in bins.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(r.length for r in out) / 2048) * 1.02 + 1
    assert best_fit_packing(none).count() == 0
