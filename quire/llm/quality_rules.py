"""Quality rules: counts from the text itself, and language-specific bands of perplexity under a model of the corpus's plain text."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import forget, written

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes that continue a UTF-8 character, and blanks: what is left of a text without them are its words' code points.
NOT_STARTS = bytes(range(0x80, 0xC0)) + BLANKS
WINDOW = 5
CONTINUED = bytes(range(0x80, 0xC0))
NOT_CAPITALS = bytes(sorted(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
#: A text trains the model with at most one symbol in so many words, and one ASCII capital in so many code points.
TRAINED_SYMBOLS, TRAINED_CAPITALS = 20, 5
HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]").search


def repeated_words(words: list[list[bytes]], width: int = WINDOW) -> list[int]:
    """Per text, its words that lie in a window of `width` words found twice or more in the text."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for text in words for w in text), np.uint64, int(sizes.sum()))
    if len(flat) < width:
        return [0] * len(words)
    text = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):  # 64-bit mixes of word numbers and text; chance collisions within one text are below 1e-9
        mixed = np.zeros(len(flat) - width + 1, np.uint64)
        for j in range(width):
            mixed = (mixed ^ flat[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ text[: len(mixed)].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(text[: len(mixed)] == text[width - 1 :])
    keys = mixed[at]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    return np.bincount(text, np.cumsum(cover)[:-1] > 0, len(words)).astype(np.int64).tolist()


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if HAS_WORD(x)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], words: list[list[bytes]]) -> list[pa.Array]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    found = ([len(t.translate(None, NOT_STARTS)) for t in texts], [len(t.translate(None, NOT_SYMBOLS)) for t in texts], [duplicate_lines(t) for t in texts], repeated_words(words))
    return [pa.array(x, pa.int64()) for x in found]


def plain(texts: list[bytes]) -> list[bool]:
    """Whether each text is fit to train the model: few symbols a word and few capitals a code point, as prose has."""
    counts = ((len(t.split()), len(t.translate(None, NOT_SYMBOLS)), len(t.translate(None, NOT_CAPITALS)), len(t.translate(None, CONTINUED))) for t in texts)
    return [words > 0 and TRAINED_SYMBOLS * symbols <= words and TRAINED_CAPITALS * capitals <= n for words, symbols, capitals, n in counts]


def apply_rules(docs: DataFrame, low: float = 0.005, high: float = 0.99, slack: float = 2.0, min_words: int = 10, max_repeat_percent: int = 20, **model) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, loss, low, high, row (a hash of id, language and text).

    The model counts all documents that are `plain`, and scores each document by the fold that it isn't in. A document
    that passes the base rules goes if its perplexity is outside its language's band: from the `low` quantile of the
    plain documents that pass, divided by `slack`, to their `high` quantile, times `slack`.

    Null or empty text: no words, so base_failed. Null lang: a language of its own, ''. A language without plain
    documents has no band: base rules decide. Null doc_id and repeated rows: a row each. Columns besides doc_id, text
    and lang are ignored. Empty tables give an empty result. `model`: see `document_scores`.
    """
    rows = docs.select("doc_id", "lang", "text")
    losses = kn.document_scores(rows, F.lit(True), measure, "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", trained=True, fit=plain, **model)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = written(losses.withColumn("base_failed", failed), "rules")
    forget(*losses._uses)
    found = kn.quantiles(scored.filter("trained and not base_failed"), {"low": low, "high": high})
    out = kn.with_limits(scored, {lang: {"low": x["low"] - math.log(slack), "high": x["high"] + math.log(slack)} for lang, x in found.items()}, "low", "high")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr("not base_failed and coalesce(loss between low and high, true)").alias("kept"), "lang", "loss", "low", "high", "row")
