"""Best-fit packing: token pieces go to as few sequences as they can, by best fit and then swap-based local search."""

from __future__ import annotations

import bisect
import functools
import gc
import json
import math
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, released, tokenizer_path, written

#: Words that a worker remembers at least; it forgets the older ones from twice as many.
MEMO_WORDS = 300_000
#: Bytes of text whose words a task holds at a time; as Python objects they take about ten times as many.
TEXT_BYTES = 2 << 20
#: Words that are encoded at a time, and words that are encoded as one text.
ENCODED, JOINED = 5_000, 500
#: Pieces that one task packs together.
GROUP = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MARKS = string.punctuation.encode()
# Bytes of marks, of plain letters and digits, and second bytes of the letters of Latin-1 (the first one is C3).
MARK, PLAIN, LATIN = (np.isin(np.arange(256), list(x)) for x in (MARKS, (string.ascii_lowercase + string.digits).encode(), set(range(0x80, 0xC0)) - {0x97, 0xB7}))
# What a tokenizer file says if its words can be encoded one by one.
FORM = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


class Encoder:
    """Ids of words by a tokenizer file that writes words in lower case and parts letters from marks.

    A word is its core, in lower case, and the ASCII marks that follow the core's last letter, which the tokenizer never
    joins. Most words of a text have come before, so a worker remembers the ids of words in lower case, and of their cores,
    from task to task, in two generations; only words that it doesn't know are looked at one by one. Words that may hold one
    of the file's added tokens, which are looked for before anything else, are encoded as they stand. A file of another form
    isn't `by_words`: its texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].lower().encode() for t in said["added_tokens"]]
        self.mark = os.path.commonprefix(self.added)
        self.by_words = all(said[k] == v for k, v in FORM.items()) and said["model"]["type"] == "BPE" and not said["model"].get("dropout") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in said["added_tokens"])
        vocabulary, suffix = self.tokenizer.get_vocab(), said["model"].get("end_of_word_suffix")
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def has_added(self, low: bytes) -> bool:
        """Whether a text in lower case may hold an added token."""
        return self.mark in low and any(x in low for x in self.added)

    def split(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, in lower case and parted between a plain letter or digit and a mark, where the tokenizer parts them too; a text that may hold an added token is split as it stands."""
        low = b" ".join(texts).lower()
        data = np.frombuffer(low, np.uint8)
        plain = PLAIN[data]
        two = np.flatnonzero(data[:-1] == 0xC3) + 1
        plain[two] = LATIN[data[two]]
        cuts = np.flatnonzero(plain[:-1] & MARK[data[1:]]) + 1
        cut = np.insert(data, cuts, 32).tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends + 1])[: len(texts)]
        spans = zip((starts + np.searchsorted(cuts, starts)).tolist(), (ends + np.searchsorted(cuts, ends)).tolist(), strict=True)
        if self.mark not in low:
            return [cut[i:j].split() for i, j in spans]
        return [t.split() if self.has_added(t.lower()) else cut[i:j].split() for t, (i, j) in zip(texts, spans, strict=True)]

    def encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word and its ids by the library. Words of letters alone are encoded many as one text, and parted after the ids that end words."""
        encode = functools.partial(self.tokenizer.encode_batch_fast, add_special_tokens=False)
        texts = {x: x.decode("utf-8", "replace") for x in words}
        letters = [x for x, t in texts.items() if t.isalpha()] if self.ends.any() else []
        groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for group, e in zip(groups, encode([" ".join(map(texts.__getitem__, g)) for g in groups]), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(group):  # else one of them is several words to the tokenizer
                held = ids.tobytes()
                for x, i, j in zip(group, [0, *ends[:-1]], ends, strict=True):
                    yield x, held[i:j]
                    del texts[x]
        for x, e in zip(texts, encode(list(texts.values())), strict=True):
            yield x, array("I", e.ids).tobytes()

    def words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each word (and of others), little-endian unsigned 32-bit."""
        young, old, late, missing, own = self.young, self.old, [], set(), {}
        for word in words.difference(young):
            if word in old:
                young[word] = old[word]
                continue
            low = word.lower()
            if self.has_added(low):
                own[word] = self.whole(word)
                continue
            core = low.rstrip(MARKS)
            if len(core) < len(low) and (core[-1:].isalnum() or core.decode("utf-8", "replace").lower()[-1:].isalpha()):
                parts = core, low[len(core) :]
            else:
                parts = (low,)
            for x in parts:
                if x not in young:
                    if x in old:
                        young[x] = old[x]
                    else:
                        missing.add(x)
            if parts != (word,):
                late.append((word, low, parts))
        missing = list(missing)
        for at in range(0, len(missing), ENCODED):  # what the library says of a word takes a kilobyte
            young.update(self.encoded(missing[at : at + ENCODED]))
        for word, low, parts in late:
            ids = young[low] = b"".join(map(young.__getitem__, parts))
            if word != low:
                own[word] = ids
        if len(young) > MEMO_WORDS:
            self.young, self.old = {}, young
        return {x: own[x] if x in own else young[x] for x in words} if own else young

    def whole(self, text: bytes) -> bytes:
        """Ids of a text as the library gives them."""
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids of every row of `docs` (doc_id, text): ids of the tokenizer file, then id 0.

    The tokenizer drops ASCII blanks and never joins what they part, so a text's ids are those of its runs without them;
    texts are encoded whole by a file that isn't of this form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        gc.disable()  # words and ids hold no cycles, and looking for some took a quarter of the time
        for batch in byte_slices(batches, "text", TEXT_BYTES):
            if encoder.by_words:
                texts = encoder.split(as_bytes(batch["text"]))
                ids_of = encoder.words(set(chain.from_iterable(texts))).__getitem__
            else:
                texts, ids_of = [[t] for t in as_bytes(batch["text"])], encoder.whole
            rows = []
            for doc, words in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                ids = b"".join(map(ids_of, words)) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that has room."""
    out = np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}  # by free room
    rooms: list[int] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at == len(rooms):
            bin_, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        out[i] = bin_
        if room > need:
            if room - need not in open_bins:
                open_bins[room - need] = []
                bisect.insort(rooms, room - need)
            open_bins[room - need].append(bin_)
    return out


def best_step(mine: np.ndarray, size: np.ndarray, room: np.ndarray, capacity: int) -> tuple[int, tuple[int, ...], int] | None:
    """The step by which a bin gives most: how much, which of its pieces (places in `mine`), for which piece (its place in `size`; -1 - place: none, they move to that piece's bin).

    `mine` are the sizes of the bin's pieces, `size` those of the other bins' pieces, and `room` what each one's bin may take.
    """
    most = room.max(initial=0)
    if (fits := np.flatnonzero(mine <= most)).size:  # the largest piece that fits, to the tightest bin
        m = int(fits[np.argmax(mine[fits])])
        to = np.flatnonzero(room >= mine[m])
        return int(mine[m]), (m,), -1 - int(to[np.argmin(room[to])])
    widest = np.full(capacity + 1, -capacity)
    np.maximum.at(widest, size, room)
    left, right = np.triu_indices(len(mine), 1)
    amounts = np.concatenate([mine, mine[left] + mine[right]])
    amounts, first = np.unique(amounts, return_index=True)
    sizes = np.flatnonzero(widest > 0)
    gain = amounts[:, None] - sizes[None, :]
    gain[(gain > widest[sizes][None, :])] = 0
    if not gain.size or gain.max() <= 0:
        return None
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    at = first[i]
    which = (int(at),) if at < len(mine) else (int(left[at - len(mine)]), int(right[at - len(mine)]))
    return int(gain[i, j]), which, int(np.flatnonzero((size == sizes[j]) & (room >= gain[i, j]))[0])


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Better bins: from the emptiest bin on, pieces move, or change places one for one or two for one with a piece of a
    bin that is at least as full and has room for the difference.

    Every step raises the sum of squared fills, and bins are visited again until none can give, which ends the search.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths, bins.max() + 1).astype(np.int64)
    item = np.flatnonzero(fill[bins] < capacity)
    size, own = lengths[item].astype(np.int64), bins[item]
    moved = True
    while moved:
        moved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        for b in under[np.argsort(fill[under], kind="stable")].tolist():
            while fill[b]:
                of = np.flatnonzero(own == b)
                room = np.where((own != b) & (fill[own] >= fill[b]), capacity - fill[own], -capacity)
                step = best_step(size[of], size, room, capacity)
                if step is None:
                    break
                gain, which, k = step
                other = int(own[k if k >= 0 else -1 - k])
                own[of[list(which)]] = other
                if k >= 0:
                    own[k] = b
                fill[b] -= gain
                fill[other] += gain
                moved = True
    bins[item] = own
    return bins


def packer(capacity: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        pdf = pdf.iloc[order].reset_index(drop=True)
        bins = np.unique(bins[order], return_inverse=True)[1]
        ends = pdf["length"].cumsum().to_numpy()
        starts = ends - pdf["length"].to_numpy()
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        group = int(pdf["g"].iloc[0])
        pdf["sequence_id"] = (level << 56) + (group << 24) + bins
        pdf["offset"] = starts - starts[first][bins]
        pdf["fill"] = np.bincount(bins, pdf["length"]).astype(np.int64)[bins]
        return pdf.drop(columns="g")

    return run


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """`pieces` (PIECE) with sequence_id and offset. Groups of pieces are packed in parallel; the pieces of sequences that
    aren't full are dealt into fewer groups and packed again, until one group holds what is left or a level needs as many
    sequences as the one before, which then stays.
    """
    rest, settled, level, before, bins = pieces, None, 0, None, 0
    while True:
        groups = max(1, math.ceil(rest.count() / group))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = written(dealt.groupBy("g").applyInPandas(packer(capacity, level), f"{PIECE}, sequence_id long, offset long, fill long"), "packed")
        used = packed.filter("offset = 0").count()
        if before is not None and used >= bins:
            last = before
        elif groups == 1:
            last = packed
        else:
            last = None
            full = packed.filter(F.col("fill") == capacity)
            settled = full if settled is None else settled.union(full)
            before = packed.filter(F.col("fill") < capacity)
            bins = used - full.filter("offset = 0").count()
            rest, level = before.select(*pieces.columns), level + 1
        if last is not None:
            return (last if settled is None else settled.union(last)).drop("fill")


def best_fit_packing(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """One row per piece of every row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then id 0; only documents of more than `capacity` ids are cut. No sequence holds more than
    `capacity` ids, and the pieces of one lie side by side from offset 0.

    Null or empty text: one piece, id 0. Null doc_id and repeated rows: packed like others, a row each. Columns besides
    doc_id and text are ignored. Empty tables give an empty result.
    """
    pieces = written(token_pieces(docs, tokenizer_path(tokenizer, folder), capacity), "pieces")
    return pack(pieces, capacity)
