"""Character sets of book files: byte-order marks, plausibility of a decoding, detection, decoding."""

from __future__ import annotations

import codecs
import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Byte-order marks in the order in which they are tried, and the candidates of detection.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32le"), (codecs.BOM_UTF32_BE, "utf-32be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
CANDIDATES = ("utf-8", "gb18030", "big5", "utf-16le", "shift_jis", "euc-kr")


def marked_charset(content: Column) -> Column:
    """Character set that a byte-order mark names, else null."""
    out = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        out = F.when(F.substring(content, 1, len(mark)) == F.lit(bytearray(mark)), name).otherwise(out)
    return out


def standard_charset(name: Column) -> Column:
    """One name for each family of character sets."""
    n = F.lower(name)
    wide = lambda w: F.when(n.contains("be") & ~n.contains("le"), f"utf-{w}be").otherwise(f"utf-{w}le")
    return (F.when(n.contains("utf-16"), wide(16)).when(n.contains("utf-32"), wide(32)).when(n.contains("gb"), "gb18030").when(n.contains("big5") | n.contains("big-5"), "big5")
            .when(n.contains("shift") | n.contains("sjis"), "shift_jis").when(n.contains("euc-kr") | (n == "euc_kr"), "euc-kr").when(n.contains("utf-8") | (n == "utf8"), "utf-8").otherwise(n))


def class_counts(text: Column) -> Column:
    """(n, broken, ideographs, common): code points of a text, of replacement characters, ideographs and common characters."""
    count = lambda x: F.regexp_count(text, F.lit(x)).cast("long")
    return F.struct(F.length(text).cast("long").alias("n"), count("\ufffd").alias("broken"), count("[一-龥]").alias("ideographs"), count("[a-zA-Z0-9 \\t\\n\\r.,!?;:\"'()《》【】\u3000]").alias("common"))


def plausible(counts: Column) -> Column:
    """Whether a decoding with these `class_counts` makes sense: 100 characters, few broken ones, many ideographs or common ones."""
    return F.when((counts["n"] < 100) | (counts["broken"] * 20 > counts["n"]), False).otherwise((counts["ideographs"] * 10 > counts["n"]) | (counts["common"] * 2 > counts["n"]))


IDEOGRAPHS, COMMON = re.compile("[一-龥]+"), re.compile("[a-zA-Z0-9 \\t\\n\\r.,!?;:\"'()《》【】\u3000]+")


def _fits(text: str) -> bool:
    n = len(text)
    if n < 100 or text.count("\ufffd") * 20 > n:
        return False
    count = lambda form: sum(map(len, form.findall(text)))
    return count(IDEOGRAPHS) * 10 > n or count(COMMON) * 2 > n


# By character set, the language's most frequent characters, the share of a text that these are taken to make
# up, and ranges of byte pairs (lead, trail) with theirs.
ANY_TRAIL = (0x40, 0xFE)
MODELS = {
    "gb18030": (
        "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实",
        0.42, (((0xB0, 0xD7), (0xA1, 0xFE), 0.40), ((0xA1, 0xA3), (0xA1, 0xFE), 0.15), ((0xD8, 0xF7), (0xA1, 0xFE), 0.02), ((0x81, 0xFE), ANY_TRAIL, 0.01)),
    ),
    "big5": (
        "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實",
        0.42, (((0xA4, 0xC6), ANY_TRAIL, 0.40), ((0xA1, 0xA3), ANY_TRAIL, 0.15), ((0xC9, 0xF9), ANY_TRAIL, 0.02), ((0x81, 0xFE), ANY_TRAIL, 0.01)),
    ),
    "shift_jis": (
        "のにはをたがでてとしれさるいあなもからこすりくっきまかんうそよだ日人一大年本中国出時行見月分後前生者間上",
        0.55, (((0x82, 0x82), (0x9F, 0xF1), 0.12), ((0x83, 0x83), (0x40, 0x96), 0.10), ((0x81, 0x81), (0x40, 0xFC), 0.10), ((0x88, 0x97), (0x40, 0xFC), 0.10), ((0x98, 0x9F), (0x40, 0xFC), 0.01), ((0xE0, 0xEA), (0x40, 0xFC), 0.01), ((0x81, 0xFC), (0x40, 0xFC), 0.01)),
    ),
    "euc-kr": (
        "이다는을에의가하고지한도로사은기를자들인어서나있리그아정시만수으대해일부라제것보전게상과장주여마지여장구세조선원신동미성소무말우경공물안생었했습니까",
        0.60, (((0xB0, 0xC8), (0xA1, 0xFE), 0.32), ((0xA1, 0xA3), (0xA1, 0xFE), 0.05), ((0xCA, 0xFD), (0xA1, 0xFE), 0.02), ((0x81, 0xFE), (0x41, 0xFE), 0.01)),
    ),
}
#: Probability of bytes that a character set has no character for, and the least confidence that names a character set.
BROKEN, CONFIDENT = 1e-7, 0.8


@functools.cache
def pair_model(name: str) -> np.ndarray:
    """Logarithm of each byte pair's probability in texts of a character set."""
    often, share, ranges = MODELS[name]
    p = np.full((256, 256), BROKEN)
    for (a, b), (c, d), part in reversed(ranges):
        p[a : b + 1, c : d + 1] = part / ((b - a + 1) * (d - c + 1))
    own = {x.encode(name) for x in often}
    for lead, trail in own:
        p[lead, trail] = share / len(own)
    return np.log(p)


def fit_of(data: bytes, name: str) -> tuple[float, int]:
    """Log likelihood of the bytes beyond ASCII as text of a character set, and how many pairs these are.

    The text is decoded and its characters are written again without the ASCII ones, so that the pairs stand in line.
    """
    text = data.decode(name, "replace")
    broken = text.count("\ufffd")
    wide = re.sub("[\\x00-\\x7f\ufffd]+", "", text).encode(name, "ignore")
    if len(wide) % 2 or any(len(x.encode(name)) != 2 for x in set(wide.decode(name, "ignore"))):  # characters of one or four bytes
        parts = [x.encode(name) for x in wide.decode(name, "ignore")]
        broken += sum(len(x) != 2 for x in parts)
        wide = b"".join(x for x in parts if len(x) == 2)
    pairs = np.frombuffer(wide, np.uint8).reshape(-1, 2)
    return float(pair_model(name)[pairs[:, 0], pairs[:, 1]].sum()) + broken * math.log(BROKEN), len(pairs) + broken


def legacy_charset(data: bytes) -> tuple[str | None, float]:
    """The likeliest of the character sets of MODELS and its confidence, the share of its likelihood among all; none for ASCII alone, or where it fits no better than bytes at random."""
    fits = {name: fit_of(data, name) for name in MODELS}
    best = max(fits, key=lambda n: fits[n][0])
    score, n = fits[best]
    if not n or score / n < math.log(1e-4):
        return None, 0.0
    return best, 1 / sum(math.exp(max(-700.0, x - score)) for x, _ in fits.values())


#: Bytes at the start of a file that the models look at.
SEEN = 1 << 16


def unmarked_charset(data: bytes) -> str:
    """Character set without a mark: UTF-8 where it holds, else the one whose byte-pair model fits with confidence, else the first candidate whose decoding is plausible, else gb18030.

    The models look at the first SEEN bytes; a few words tell the character sets apart.
    """
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        name, confidence = legacy_charset(data[:SEEN])
        return name if confidence > CONFIDENT else next((c for c in CANDIDATES if _fits(data.decode(c, "replace"))), "gb18030")


def text_of(data: bytes, charset: str | None = None) -> str:
    """Text of bytes, broken ones replaced, without a byte-order mark; of the character set that their mark or detection says, if none is given."""
    charset = charset or next((name for mark, name in MARKS if data.startswith(mark)), None) or unmarked_charset(data)
    return data.decode(charset, "replace").removeprefix("\ufeff")


@F.pandas_udf(StringType())
def detected_charset(content: pd.Series) -> pd.Series:
    """`unmarked_charset` of a column."""
    return content.map(lambda data: None if data is None else unmarked_charset(data))


@F.pandas_udf(StringType())
def decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """`text_of` of columns."""
    return pd.Series([None if x is None else text_of(x, c) for x, c in zip(content, charset, strict=True)])


def charset(content: Column) -> Column:
    """Character set of bytes, by their mark or by detection, which reads unmarked bytes alone."""
    mark = marked_charset(content)
    return F.coalesce(mark, detected_charset(F.when(mark.isNull(), content)))
