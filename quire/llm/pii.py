"""Personal data: regular expressions propose spans, checks confirm them, and words nearby raise or lower their score.

The base kinds are found by their patterns alone: a proposal that fails its check goes, and nothing is tried again inside
it. More spans (bank accounts by their mod-97 check, shorter card numbers, national phone numbers, social security numbers)
need a score, which their check, the words around and the absence of other spans make up.

Patterns are written so that each reads a text once: runs are taken whole (possessively), and an address is looked for
around its @, so a run of a million digits or letters costs no more than any other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

# Kinds in the order of results, scores in hundredths, words that speak for a kind and against numbers, and
# the lengths of bank account numbers by country.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_SCORE = {"email": 95, "ip": 60, "card": 80, "phone": 75}
LEAST_SCORE, SPEAKS_FOR, SPEAKS_AGAINST, BEFORE, AFTER = 60, 35, 40, 48, 16
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "tarjeta", "kreditkarte", "karte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "téléphone", "portable", "teléfono", "móvil"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "sku", "build", "release", "part no", "article", "rechnung", "facture", "factura")
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SHORT_CARD = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])(?![A-Za-z])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}+(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ -]?[0-9A-Z]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")
WORDS = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)", re.IGNORECASE) for k, v in (CONTEXT | {"": AGAINST}).items()}


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others: every second one counts double, less 9 where that has two digits."""
    doubled = sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether a bank account number, country and check digits moved to its end and letters as 10 to 35, leaves 1 over 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ with a domain, all local characters before it that no earlier address holds."""
    taken = seen = 0
    for m in DOMAIN.finditer(text):
        before = text[max(taken, seen) : m.start()]
        start = m.start() - (len(before) - len(before.rstrip(LOCAL)))
        seen = m.start() + 1  # no local part goes past another @
        if start < m.start():
            yield start, (taken := m.end())


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the base kinds that pass their checks, by kind, then place."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                yield "ip", m.start(), m.end()
        for m in CARD.finditer(text):
            if 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int, least: int) -> int:
    """`least` with what the words nearby add or take."""
    around = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    has = lambda words: any(words.search(x) for x in around)
    return max(0, min(100, least + SPEAKS_FOR * has(WORDS[kind]) - SPEAKS_AGAINST * has(WORDS[""])))


def more_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Spans with scores besides those of the base, which they never overlap; nor do they overlap each other."""
    taken = [(s, e) for _, s, e in base]
    proposals: list[tuple[str, int, int, int]] = []
    for m in IBAN.finditer(text):
        n, end = IBAN_LENGTH.get(m[0][:2], 0), m.start()
        for at in range(m.start(), m.end()):  # as many letters and digits as the country's numbers have
            n -= text[at] not in " -"
            if not n:
                end = at + 1
                break
        account = re.sub("[ -]", "", text[m.start() : end])
        if end > m.start() and not re.match("[0-9A-Za-z]", text[end : end + 1]) and mod97(account):
            proposals.append(("iban", m.start(), end, 75))
    for m in SHORT_CARD.finditer(text):
        digits = digits_of(m[0])
        if luhn(digits) and (digits[0] == "4" and len(digits) == 13 or digits[:2] in ("30", "36", "38") and len(digits) == 14 or digits[:2] in ("34", "37") and len(digits) == 15):
            proposals.append(("card", m.start(), m.end(), 40))
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            proposals.append(("ssn", m.start(), m.end(), 40))
    if WORDS["phone"].search(text):
        for m in NATIONAL.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 13:
                proposals.append(("phone", m.start(), m.end(), 30))
    for kind, s, e, least in proposals:
        if not any(s < y and x < e for x, y in taken) and (points := score(text, kind, s, e, least)) >= LEAST_SCORE:
            taken.append((s, e))
            yield kind, s, e, points


def spans_of(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, score, base) by kind in the order of KINDS, then place; ends are exclusive, in code points."""
    base = list(base_spans(text))
    found = [(k, s, e, score(text, k, s, e, BASE_SCORE[k]), True) for k, s, e in base]
    if DIGIT.search(text):
        found += [(*x, False) for x in more_spans(text, base)]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, spans: list[tuple[str, int, int, int, bool]]) -> str:
    """The text with [KIND] for each span; of overlapping spans the first names the kind of all."""
    out, at = [], 0
    for kind, s, e, *_ in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: int, base: boolean>>"


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """(doc_id, spans) of each row of `docs` (doc_id, text), with `mask` also masked_text. A span is (kind, start, end, score, base).

    Null text: no spans, and null where masked. A null doc_id is carried; repeated rows are searched each. Texts are searched
    whole. Columns besides doc_id and text are ignored. Empty tables give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found, texts = [], []
            for value in batch["text"]:
                text = value.as_py()
                found.append(spans := spans_of(text or ""))
                texts += [text if text is None else masked(text, spans)] * mask
            flat = [x for spans in found for x in spans]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            fields = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
            ends = [0]
            for spans in found:
                ends.append(ends[-1] + len(spans))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "score", "base"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], listed, *[pa.array(texts, pa.string())] * mask], ["doc_id", "spans", *["masked_text"] * mask])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}" + ", masked_text string" * mask)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of found spans: base spans counted and hashed, all spans as text."""
    base = F.filter("spans", lambda x: x["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
