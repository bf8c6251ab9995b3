"""Column functions of titles, names, sizes and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as blank at the ends of a text, and the default author.
BLANKS = r" \t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = f"[{BLANKS}]"
NO_AUTHOR = "佚名"


def trimmed(text: Column) -> Column:
    """`text` without blanks at both ends, the ideographic blank and byte-order marks included."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


@F.pandas_udf(StringType())
def unmarked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining accents; Spark has no function for it."""
    for s in parts:
        yield s.str.normalize("NFKD").str.replace(r"[\u0300-\u036f]", "", regex=True)


def slug(text: Column) -> Column:
    """Ids of names: runs of other characters than ASCII letters, digits and common ideographs become one hyphen. Of ASCII texts Python gets a null."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    plain = F.coalesce(unmarked(odd), text)
    return F.lower(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9一-龥]+", "-"), "^-+|-+$", ""))


def book_name(filename: Column) -> Column:
    """(title, author) of a file name `《title》... 作者：author.rar`, or its stem and the default author."""
    stem = F.regexp_replace(filename, r"(?i)\.rar$", "")
    form = r"^《(.+?)》.*?作者[:：]\s*(.+)$"
    full = stem.rlike(form)
    title = F.when(full, trimmed(F.regexp_extract(stem, form, 1))).otherwise(stem)
    author = F.when(full, trimmed(F.regexp_extract(stem, form, 2))).otherwise(F.lit(NO_AUTHOR))
    return F.struct(title.alias("title"), author.alias("author"))


def tenths(part: Column, whole: Column) -> Column:
    """`part / whole` with one digit after the point, halves up, by whole numbers alone."""
    n = F.floor((part * 20 + whole) / (whole * 2)).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def mib_label(size: Column) -> Column:
    return tenths(size, F.lit(1048576))


def percent(position: Column, total: Column) -> Column:
    """'12.3' for a place in a text; an empty text is at 0.0."""
    return F.when(total > 0, tenths(position * 100, total)).otherwise("0.0")


def preview(text: Column, most: int = 20) -> Column:
    """Start of the first line that isn't blank; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, most), F.lit(""))


def minute_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm")


def iso_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_label(seconds: Column) -> Column:
    """'2m 5s'."""
    return F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds % 60))


def download_names(title: Column) -> Column:
    """(ascii, utf8) file names for a download header."""
    plain = F.concat(F.regexp_replace(title, r"[^\x20-\x7E]", "_"), F.lit(".txt"))
    return F.struct(plain.alias("ascii"), F.replace(F.url_encode(F.concat(title, F.lit(".txt"))), F.lit("+"), F.lit("%20")).alias("utf8"))


def one_newline(text: Column) -> Column:
    """Line ends of all kinds as a newline."""
    return F.regexp_replace(text, "\r\n?", "\n")


def whole_mib(size: Column) -> Column:
    """Mebibytes, rounded half up."""
    return F.floor((size * 2 + 1048576) / 2097152).cast("long")


def large_file(size: Column, most: int = 30) -> Column:
    """Whether a file is worth a warning."""
    return whole_mib(size) > most


def scan_percent(done: Column, total: Column) -> Column:
    """Per cent of a scan after `done` of `total` files, rounded half up; null where none is shown: not a tenth and not the end."""
    shown = (done % F.greatest(F.floor(total / 10), F.lit(1)) == 0) | (done == total)
    return F.when(shown, F.floor((done * 200 + total) / (total * 2)).cast("long"))


def place_label(percent_text: Column, start: Column) -> Column:
    """What is kept as a place's title: per cent, and the start of the text if there is any."""
    return F.when(start != "", F.concat(percent_text, F.lit("% · "), start, F.lit("..."))).otherwise(F.concat(F.lit("已读 "), percent_text, F.lit("%")))


def option(args: Column, name: str, default: str) -> Column:
    """Value of the last `--name=value` of a list of arguments."""
    found = F.filter(args, lambda a: F.startswith(a, F.lit(f"--{name}=")))
    return F.coalesce(F.get(F.split(F.try_element_at(found, F.lit(-1)), "="), F.lit(1)), F.lit(default))
