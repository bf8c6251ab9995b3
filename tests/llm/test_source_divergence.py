"""Divergence of sources against a brute-force version that visits every group and term."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from quire.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, value long, v int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, most=200):
    count, total, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        count[lang, source].update(words)
        total[lang].update(words)
        found[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least]

        def shares(c, kept=kept):
            m = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // m for t in kept}

        q = shares(total[lang])
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            rows = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in rows.items():
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= most:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, docs, **how):
    rows = [(i, t, x, s, 1, "x", 2, 3) for i, (t, x, s) in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in sd.divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_same_as_brute_force(spark):
    r = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{'é' * (i // 26)}" for i in range(60)] + ["ÉCOLE", "Straße", "日本", "𝒳y", "A"]
    docs = [(" ".join(r.choices(words[: 20 + 5 * k], k=r.randint(0, 40))) + r.choice(["", ".", "\x00x9y"]), r.choice(["en", "en", "de"]), f"s{min(k, r.randint(0, 6))}") for k in range(8) for _ in range(12)]
    docs += [(None, "en", "empty"), ("", "fr", None), ("a b a", None, None), ("a b", None, "t"), ("b a", None, ""), (None, None, "u"), ("Solo words here", "it", "x"), ("other", "it", "y"), ("a " * 3000, "en", "hot")] + [docs[0]] * 5
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, least_docs=1, most_terms=3) == brute(docs, 1, 3)


def test_small_steps_count_the_same(spark, monkeypatch):
    """Long texts split at blanks, counts sent on early, groups too many to broadcast."""
    docs = [("ab cd " * 50 + "x" * 300 + " ab", "en", "a"), ("cd ef 1 ab", "en", "b"), ("ab cd ef", "en", "c"), ("ef ef", "en", "b")]
    assert [w for part in sd.terms_of(b"aB c" * 3_000_000) for w in part] == (b"ab c" * 3_000_000).split()
    monkeypatch.setattr(sd, "HELD", 2)
    monkeypatch.setattr(sd, "STEP", 7)
    monkeypatch.setattr(sd, "BROADCAST_GROUPS", 1)
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_of_large_counts(spark):
    """Counts beyond what longs hold after scaling are exact."""
    cases = [(0, 1), (8_999_999_999, 10**10), (9_000_000_000, 10**10), (7 * 10**15, 10**16 + 1), (10**18, 10**18 + 3)]
    found = spark.createDataFrame(cases, "c long, m long").select("c", "m", sd.share(F.col("c"), F.col("m")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (r.c + 1) // r.m for r in found]
