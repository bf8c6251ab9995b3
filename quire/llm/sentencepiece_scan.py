"""SentencePiece encoding and decoding: merge (BPE) files by their merges, unigram files by the best path.

A merge file's scores are ranks of merges, whose sum means nothing: its texts are merged pair by pair, best rank first.
No merge crosses two characters that stand side by side in no piece, so giant documents are cut there; what lies between
the last such place of a chunk and the first of a later one is put together and merged as one.

Unigram files take a max-plus parallel scan. The best path through a text maximises the sum of its pieces' scores. A chunk of a giant document maps the state at its
start (how many of its characters the piece from before covers) to the state at its end by a max-plus matrix. Matrices
combine associatively: a scan gives every chunk the best scores of its entry states, from which it backtraces by itself,
once per exit state; the exits are then chosen from the last chunk to the first.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, tokenizer_path, written

MEMO_UNITS = 300_000
#: Code points from which a document is giant, and those of its chunks.
GIANT = 60_000
CHUNK = 20_000
#: Chunks whose matrices one task combines.
BLOCK = 64
LOW = float("-inf")
#: Characters from which a text is merged by a heap, and beyond which it is not remembered.
LONG = 200
BLANK = "▁"


class Model:
    """Pieces and scores of a model file, and the merges of or the best paths through short texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        kinds = type(spec).SentencePiece
        if spec.trainer_spec.model_type not in (1, 2) or any(x.type in (kinds.USER_DEFINED, kinds.UNUSED) for x in spec.pieces):
            raise ValueError(f"{path}: only unigram and BPE models without user-defined and unused pieces")
        self.merges = spec.trainer_spec.model_type == 2
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in plain.items()}
        self.unknown = min(scores.values()) - 10
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.table: dict[str, tuple[int, int] | None] = {p[:n]: None for p in plain for n in range(1, len(p))}
        self.table |= {p: (scores[p], i) for p, i in plain.items()}
        self.ids, self.scores = plain, scores
        self.inner = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.longest = max(map(len, plain))
        self.written = [bytes([b]) if (b := next((k for k, v in self.bytes.items() if v == i), None)) is not None and sp.is_byte(i) else sp.id_to_piece(i).encode() if sp.id_to_piece(i) in plain else b"" for i in ids]
        alphabet = {c for p in plain for c in p}
        breaks = "".join(c for c in "\n\t\r" if c not in alphabet)
        # no piece goes on over a blank that follows another character, nor over a character of none: paths meet there
        cut = not any(BLANK in p.lstrip(BLANK) for p in plain)
        self.unit = re.compile(f"{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+" + (f"|[{breaks}]" if breaks else ""), re.S) if cut else re.compile(".+", re.S)
        self.known: dict[str, tuple[float, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Symbols of a text after all merges: the pair of the best score first, the leftmost of equal ones."""
        symbols, get = list(text), self.scores.get
        if len(symbols) < LONG:
            pairs = [get(a + b, LOW) for a, b in zip(symbols, symbols[1:], strict=False)]
            while pairs and (best := max(pairs)) > LOW:
                i = pairs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get(symbols[i - 1] + symbols[i], LOW)
                if i < len(pairs):
                    pairs[i] = get(symbols[i] + symbols[i + 1], LOW)
            return symbols
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-score, i, 2) for i in range(n - 1) if (score := get(symbols[i] + symbols[i + 1], LOW)) > LOW]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j == n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (score := get(symbols[a] + symbols[b], LOW)) > LOW:
                    heapq.heappush(heap, (-score, a, len(symbols[a]) + len(symbols[b])))
        return [x for x in symbols if x]

    def merge(self, text: str) -> bytes:
        """Ids of a text by merges, part by part between places that no piece crosses."""
        ids, out, inner = self.ids, [], self.inner
        places = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inner), len(text)] if len(text) >= LONG else [0, len(text)]
        for start, end in zip(places[:-1], places[1:], strict=True):
            for x in self.merged(text[start:end]):
                if x in ids:
                    out.append(ids[x])
                else:
                    out += [self.bytes.get(b, 0) for b in x.encode()]
        return np.array(out, "<u2").tobytes()

    def parts(self, behind: str, body: str) -> list[tuple[int, str | None, bytes | None]]:
        """(part, text, ids) of a chunk after the character `behind` it: 0, the text up to the first place that no piece crosses, 1, the ids up to the last one, 2, the text from there; the first and the last are merged with those of other chunks."""
        text, n = behind + body, len(behind)
        first = next((i for i in range(len(body)) if i + n == 0 or text[i + n - 1 : i + n + 1] not in self.inner), None)
        if first is None:
            return [(0, body, None)]
        last = next((i for i in range(len(body) - 1, first, -1) if text[i + n - 1 : i + n + 1] not in self.inner), first)
        return [(0, body[:first], None), (1, None, self.encode(body[first:last])), (2, body[last:], None)]

    def paths(self, text: str, starts: dict[int, float], end: int) -> tuple[list[float], list[tuple[int, int]]]:
        """Best score of each place of `text` up to `end` and as far as pieces that start before reach, from the given places' scores; the piece (start, id) that gives it."""
        reach = min(len(text), end + self.longest - 1)
        best, back = [LOW] * (reach + 1), [(-1, -1)] * (reach + 1)
        for at, score in starts.items():
            if at <= reach:
                best[at] = score
        table = self.table
        for i in range(end):
            base = best[i]
            if base <= LOW:
                continue
            single = False
            for j in range(i + 1, min(reach, i + self.longest) + 1):
                piece = text[i:j]
                if piece not in table:
                    break
                if found := table[piece]:
                    single |= j == i + 1
                    if base + found[0] > best[j]:
                        best[j], back[j] = base + found[0], (i, found[1])
            if not single and i < reach and base + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = base + self.unknown, (i, -1)
        return best, back

    def trace(self, text: str, back: list[tuple[int, int]], at: int) -> tuple[int, bytes]:
        """Where the path that ends at `at` starts, and its ids."""
        out: list[list[int]] = []
        while back[at][0] >= 0:
            i, piece = back[at]
            out.append([piece] if piece >= 0 else [self.bytes.get(b, 0) for b in text[i:at].encode()])
            at = i
        return at, np.array([x for part in reversed(out) for x in part], "<u2").tobytes()

    def encode_unit(self, unit: str) -> tuple[int, bytes]:
        if len(self.known) > MEMO_UNITS:
            self.known.clear()
        if self.merges:
            found = 0.0, self.merge(unit)
        else:
            best, back = self.paths(unit, {0: 0.0}, len(unit))
            found = best[len(unit)], self.trace(unit, back, len(unit))[1]
        if len(unit) <= LONG:
            self.known[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole normalised text."""
        known, units = self.known, self.unit.findall(text)
        try:
            return b"".join([known[u][1] for u in units])
        except KeyError:
            return b"".join([(known.get(u) or self.encode_unit(u))[1] for u in units])

    def cuts(self, body: str, ahead: str) -> tuple[int, int] | None:
        """Two places of a chunk that every path passes, the first beyond all entry states, as far apart as there are."""
        ends = [m.start() for m in self.unit.finditer(body + ahead) if self.longest <= m.start() <= len(body)]
        return (ends[0], ends[-1]) if ends else None

    def matrix(self, body: str, ahead: str) -> np.ndarray:
        """Transfer matrix of a chunk: best score from each entry state to each exit state."""
        n, text, states = len(body), body + ahead, self.longest
        out = np.full((states, states), LOW)
        cut = self.cuts(body, ahead)
        if not cut:
            for e in range(min(states, n + 1)):
                best = self.paths(text, {e: 0}, n)[0][n : n + states]
                out[e, : len(best)] = best
        else:
            first, last = cut
            head = [self.paths(text[:first], {e: 0}, first)[0][first] for e in range(states)]
            middle = sum((self.known.get(u) or self.encode_unit(u))[0] for u in self.unit.findall(text[first:last]))
            tail = self.paths(text[last:], {0: 0}, n - last)[0][n - last : n - last + states]
            for e in range(states):
                for x, t in enumerate(tail):
                    if head[e] > LOW and t > LOW:
                        out[e, x] = head[e] + middle + t
        return out

    def chunk(self, body: str, ahead: str, entry: np.ndarray) -> list[tuple[int, bytes] | None]:
        """Per exit state, the entry state and the ids of the best path, given the entry states' best scores."""
        n, text = len(body), body + ahead
        starts = {e: s for e, s in enumerate(entry.tolist()) if s > LOW}
        cut = self.cuts(body, ahead)
        if not cut:
            best, back = self.paths(text, starts, n)
            return [self.trace(text, back, n + x) if n + x < len(best) and best[n + x] > LOW else None for x in range(self.longest)]
        first, last = cut
        state, ids = self.trace(text[:first], self.paths(text[:first], starts, first)[1], first)
        ids += self.encode(text[first:last])
        rest = text[last:]
        best, back = self.paths(rest, {0: 0}, n - last)
        return [(state, ids + self.trace(rest, back, n - last + x)[1]) if n - last + x < len(best) and best[n - last + x] > LOW else None for x in range(self.longest)]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the blank that encoding puts in front."""
        out = b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return out[1:] if out.startswith(" ") else out


@functools.lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def normalised(text: str) -> str:
    """What the model file's rules make of a text: blanks become pieces' blanks, one more in front; nothing else changes."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def product(pdf: pd.DataFrame, states: int) -> pd.DataFrame:
    """Max-plus product of the matrices of a block of chunks, in order: the block's own transfer matrix."""
    pdf = pdf.sort_values("k", ignore_index=True)
    whole = None
    for m in pdf["matrix"]:
        m = np.frombuffer(m).reshape(states, states)
        whole = m if whole is None else (whole[:, :, None] + m[None]).max(1)
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "k": [int(pdf["block"].iloc[0])], "matrix": [whole.tobytes()]})


def scan(pdf: pd.DataFrame, states: int) -> pd.DataFrame:
    """Best scores of the entry states of chunks or blocks, from their matrices and, if there is a column `entry`, the scores at the first one."""
    pdf = pdf.sort_values("k", ignore_index=True)
    out = []
    if "entry" in pdf:
        now = np.frombuffer(pdf["entry"].iloc[0]).copy()
    else:
        now = np.full(states, LOW)
        now[0] = 0
    for m in pdf["matrix"]:
        out.append(now.tobytes())
        through = now[:, None] + np.frombuffer(m).reshape(states, states)
        now = through.max(0)
        if now.max() > LOW:  # scores relative to the best: paths stay the same, and sums stay small
            now[now > LOW] -= now.max()
    return pdf[["row", "k"]].assign(entry=out)


def entry_scores(matrices: DataFrame, states: int) -> DataFrame:
    """(row, k, entry) of chunks (row, k, matrix). The matrices of each block of chunks are combined on their own, a scan over the blocks' products gives their first scores, and from there blocks are scanned side by side."""
    rows = written(matrices.withColumn("block", F.floor(F.col("k") / BLOCK).cast("int")), "matrices")
    products = rows.groupBy("row", "block").applyInPandas(lambda pdf: product(pdf, states), "row long, k int, matrix binary")
    first = products.groupBy("row").applyInPandas(lambda pdf: scan(pdf, states), "row long, k int, entry binary").withColumnRenamed("k", "block")
    return rows.join(first, ["row", "block"]).groupBy("row", "block").applyInPandas(lambda pdf: scan(pdf, states), "row long, k int, entry binary")


def choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exit state of each of a document's chunks, from the last one backwards."""
    pdf = pdf.sort_values("k", ascending=False, ignore_index=True)
    at, out = 0, []
    for froms in pdf["froms"]:
        out.append(at)
        at = int(np.asarray(froms)[at])
    return pdf[["row", "k"]].assign(exit=out)


def merge_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of documents from their chunks (doc_id, row, k, behind, body), by merges.

    A span of text runs from the last cut of a chunk to the first one of a later chunk; spans are put together by number.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "body"):
            out = [(d, r, k, *x) for d, r, k, c, b in zip(*(batch[n].to_pylist() for n in ("doc_id", "row", "k", "behind", "body")), strict=True) for x in m.parts(c, b)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["doc_id", "row", "k", "part", "text", "ids"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "text", 2 << 20):
            found = pa.array([m.encode(t.decode()) for t in as_bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["span"], pa.array(np.zeros(batch.num_rows, np.int32)), found], ["doc_id", "row", "span", "part", "ids"])

    cut = chunks.select("doc_id", "row", "k", "behind", "body").mapInArrow(parts, "doc_id long, row long, k int, part int, text string, ids binary")
    by = W.partitionBy("row").orderBy("k", "part").rowsBetween(W.unboundedPreceding, 0)
    cut = written(cut.withColumn("span", F.sum((F.col("part") == 2).cast("long")).over(by)), "parts")
    texts = cut.filter("part <> 1").groupBy("doc_id", "row", "span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    ids = texts.mapInArrow(spans, "doc_id long, row long, span long, part int, ids binary").union(cut.filter("part = 1").select("doc_id", "row", "span", "part", "ids"))
    return joined_ids(ids, "span", "part")


def joined_ids(parts: DataFrame, *order: str) -> DataFrame:
    """(doc_id, ids) of documents from parts (doc_id, row, ids), put together by the columns of `order`."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct(*order, "ids"))), lambda x: x["ids"])
    return parts.groupBy("doc_id", "row").agg(F.array_join(F.transform(whole, F.hex), "").alias("ids")).select("doc_id", F.unhex("ids").alias("ids"))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, ids (unsigned 16-bit, little-endian).

    Documents of over `giant` code points are cut into chunks of `chunk`; others are encoded whole. Merge files give the
    library's ids; a text without any place that no piece crosses is merged in one task. Unigram files: scores are
    summed in double precision; of equal paths, the one with the longer last piece wins, as in sequential encoding. A
    character of no piece becomes its bytes' pieces. Null or empty text: no ids. Null doc_id and repeated rows: a row each. Other
    columns are ignored. Empty tables give an empty result.
    """
    path = tokenizer_path(model, folder)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([m.encode(normalised(t.decode("utf-8", "replace"))) for t in as_bytes(batch["text"])], pa.binary())], ["doc_id", "ids"])

    small = rows.filter(F.length("text") <= giant).mapInArrow(whole, "doc_id long, ids binary")
    states, merges = model_of(path).longest, model_of(path).merges
    large = rows.filter(F.length("text") > giant).select("doc_id", F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            for doc, row, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                at = list(range(0, len(text), chunk))
                for few in (at[i : i + 200] for i in range(0, len(at), 200)):
                    cols = [pa.array([doc] * len(few), pa.int64()), pa.array([row] * len(few), pa.int64()), pa.array([i // chunk for i in few], pa.int32()), *(pa.array([text[max(0, i + a) : max(0, i + b)] for i in few], pa.string()) for a, b in ((-1, 0), (0, chunk), (chunk, chunk + states - 1)))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "k", "behind", "body", "ahead"])

    large = written(large.mapInArrow(cut, "doc_id long, row long, k int, behind string, body string, ahead string").repartition(F.col("row"), F.col("k")), "chunks")

    if merges:
        return small.union(merge_chunks(large, path))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "body"):
            found = [m.matrix(b, a).tobytes() for b, a in zip(batch["body"].to_pylist(), batch["ahead"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["k"], pa.array(found, pa.binary())], ["row", "k", "matrix"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "body"):
            found = [m.chunk(b, a, np.frombuffer(e)) for b, a, e in zip(batch["body"].to_pylist(), batch["ahead"].to_pylist(), batch["entry"].to_pylist(), strict=True)]
            cols = [batch["doc_id"], batch["row"], batch["k"], pa.array([[x[0] if x else -1 for x in f] for f in found], pa.list_(pa.int32())), pa.array([[x[1] if x else None for x in f] for f in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "k", "froms", "ids"])

    entries = entry_scores(large.select("row", "k", "body", "ahead").mapInArrow(matrices, "row long, k int, matrix binary"), states)
    traced = written(large.join(entries, ["row", "k"]).mapInArrow(chunks, "doc_id long, row long, k int, froms array<int>, ids array<binary>"), "traced")
    exits = traced.select("row", "k", "froms").groupBy("row").applyInPandas(choose, "row long, k int, exit int")
    joined = traced.join(exits, ["row", "k"]).select("doc_id", "row", "k", F.expr("try_element_at(ids, exit + 1)").alias("ids"))
    return small.union(joined_ids(joined, "k"))


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """One row per row of `encoded` (doc_id, ids): doc_id, n_tokens, ids_crc32, text. Null ids: none, and an empty text."""
    path = tokenizer_path(model, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(path)
        for batch in byte_slices(batches, "ids", 1 << 20):
            ids = [x or b"" for x in batch["ids"].to_pylist()]
            cols = [batch["doc_id"], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([m.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")
